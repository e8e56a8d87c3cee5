"""Column helpers shared by all operators (all built-in Spark functions)."""

from lakeledger.functions.layers import (
    LAYER_PREFIXES, EXCLUDE_PREFIXES, OTHER_LAYER, REFRESH_FREQUENCIES,
    detect_layer, excluded,
)
from lakeledger.functions.empties import (
    nullify_empty, has_text, first_truthy, differs_text, differs_flag,
)
from lakeledger.functions.text import value_text, iso_text

__all__ = [
    "LAYER_PREFIXES", "EXCLUDE_PREFIXES", "OTHER_LAYER", "REFRESH_FREQUENCIES",
    "detect_layer", "excluded", "nullify_empty", "has_text", "first_truthy",
    "differs_text", "differs_flag", "value_text", "iso_text",
]
