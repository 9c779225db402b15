from . import columns, patterns  # noqa: F401
