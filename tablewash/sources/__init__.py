from .csv import load_csv, csv_bad_rows, load_csv_dir, list_csv_files, export_csv, export_name, DirLoad
from .catalog import (save_table, list_tables, drop_tables_with_prefix,
                      project_table_name)
from .inspect import describe, describe_rows, preview, preview_rows

__all__ = ["load_csv", "csv_bad_rows", "load_csv_dir", "list_csv_files", "export_csv", "export_name",
           "DirLoad", "save_table", "list_tables", "drop_tables_with_prefix",
           "project_table_name", "describe", "describe_rows", "preview", "preview_rows"]
