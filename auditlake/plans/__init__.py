from . import registry, live, records  # noqa: F401, I001  the others add to the registry
