"""Sources: where frames come from."""

from .tables import CSVSource, DataFrameSource, DictSource, FrameSource, GlobSource, ListSource, ManualTableSource, ParquetSource, Source, SourceRegistry, VersionedSource

__all__ = ["CSVSource", "DataFrameSource", "DictSource", "FrameSource", "GlobSource", "ListSource", "ManualTableSource", "ParquetSource", "Source", "SourceRegistry", "VersionedSource"]
