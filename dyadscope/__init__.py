"""dyadscope: hold-out governed search over matched-pair choice models, on PySpark."""

from dyadscope.settings import ScanSettings

__all__ = ["ScanSettings"]
