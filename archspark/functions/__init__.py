"""Column expressions (JVM-side built-ins only)."""

from archspark.functions.paths import (  # noqa: F401
    basename, extension, first_segment, is_code_file, is_database_file,
    is_entry_point, is_ignored, is_readme, is_test_path, normalise, stem,
)
from archspark.functions.scores import clamp, density_bucket, pct  # noqa: F401
