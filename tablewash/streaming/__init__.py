from .clean import clean_stream, read_csv_stream, run_to_parquet

__all__ = ["clean_stream", "read_csv_stream", "run_to_parquet"]
