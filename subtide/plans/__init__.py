"""Query catalogues: each module has QUERIES and ORACLES."""

MODULES = ["intervals", "model", "mending", "stripping", "formats"]
