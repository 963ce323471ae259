"""DataFrame -> DataFrame operators; every one is usable with ``df.transform``."""
