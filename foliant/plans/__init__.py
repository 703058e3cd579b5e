"""Queries over the given tables that exercise every operator."""


def registered():
    """All queries and the SQL of those that have one."""
    from foliant.plans import catalog, catalog_files, catalog_stream, catalog_text  # noqa: F401

    return catalog.REGISTRY, catalog.ORACLE
