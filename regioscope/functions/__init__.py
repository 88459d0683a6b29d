"""Column expressions: R semantics, text, dates, geometry."""

from regioscope.functions import dates, geo, rsem, text  # noqa: F401
