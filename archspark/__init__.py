"""archspark: code-repository analytics expressed as Spark DataFrame plans.

Every operator is ``DataFrame(s) in -> DataFrame out``; column names are
arguments so the same operator runs on a code corpus and on the bound
driver tables (see ``archspark.plans.bindings``).
"""

__version__ = "0.1.0"
