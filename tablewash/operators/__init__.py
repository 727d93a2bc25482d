from .profile import (profile, Profile, null_counts, duplicates_count,
                      duplicates_count_df, profile_counts, profile_columns)
from .clean import (auto_clean, auto_clean_with_log, rename_columns, clean_values,
                    clean_text, drop_columns, drop_columns_log, not_null, NULL_LIKE)
from .convert import (suggest_types, convert_types, conversion_report,
                      convert_with_report, suggested_conversions)
from .dedup import (exact_duplicate_rows, duplicate_groups, entity_key, entity_key_df, entity_duplicate_keys,
                    entity_duplicates, remove_duplicates, find_duplicates,
                    DuplicateReport)
from .impute import (impute, impute_with_log, imputation_values, fill_nulls, mode_value, mode_values,
                     suggest_imputations, allowed_strategies)
from .quantiles import exact_quantiles, median
from .eda import (numeric_summary, numeric_counts, value_counts, top_values, categorical_summary,
                  correlation_pairs, correlation_long, correlation_matrix,
                  correlation_band, numeric_table, top_values_text,
                  statistical_summary, summary_rows, StatisticalSummary)
from .insights import (detect_insights, insights_list, correlation_insights, outlier_insights,
                       outlier_counts, imbalance_insights)
from .charts import bar_chart_data, scatter_data, chart_data, suggest_charts

__all__ = [n for n in dir() if not n.startswith("_")]
