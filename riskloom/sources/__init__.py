from .tables import TABLES, load, nan_to_null, read_csv, read_headerless  # noqa: F401
from .vitals import vitals, vitals_exprs, vitals_from_orders, vitals_sql  # noqa: F401
