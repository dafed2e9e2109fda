"""DataFrame -> DataFrame operators over the tables of ``marlgate.schemas``."""
