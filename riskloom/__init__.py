"""riskloom: tabular feature engineering, imputation, rule scores, evaluation
and risk stratification as Spark DataFrame plans.

Every public operator takes and returns a ``DataFrame`` (or builds a
``Column``).  Statistics that a later projection needs (medians, scaler
moments, category levels) are computed in one aggregate and carried back as
literals, so the row-level work stays inside whole-stage codegen.
"""

__version__ = "0.1.0"
