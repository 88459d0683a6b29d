"""DataFrame -> DataFrame operators (use through ``df.transform``)."""
