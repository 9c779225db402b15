from . import calendar, derive, gaps, histograms, links, pairs, ratios, tags, terms, tokens  # noqa: F401
