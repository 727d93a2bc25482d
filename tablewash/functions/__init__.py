from .columns import (qcol, is_text, is_numeric, is_floating,
                      require_columns, finite_or_null,
                      nan_to_null, unpivot_row)
from .names import normalize_name, normalize_names, clean_dataset_name
from .casts import guarded_cast, parse_type, type_label

__all__ = [
    "qcol", "is_text", "is_numeric", "is_floating",
    "require_columns", "finite_or_null", "nan_to_null",
    "unpivot_row", "normalize_name", "normalize_names", "clean_dataset_name",
    "guarded_cast", "parse_type", "type_label",
]
