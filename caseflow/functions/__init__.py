"""Column functions: text, names, dates, counts and similarity. No Python UDFs."""

from .base import let
from .counts import num, other_text, sanction_count, strip_label
from .dates import (
    date_to_serial, days_ago, display_date, month_label, norm_year, parse_class_year, parse_date, serial_to_date,
)
from .names import (
    first_name, form_name_to_display, last_name, display_name, name_distance, name_key, name_parts,
    parts_distance, single_name, split_names, strip_rank, title_case,
)
from .similarity import bigrams, cosine, dice, numbered_bigrams, set_dice, unit_vector
from .text import (
    collapse, emails_in, filename_key, fill_template, form_id, is_email, name_from_address, name_likeness,
    norm_text, parse_filename, split_camel,
)

__all__ = [
    "let", "num", "other_text", "sanction_count", "strip_label", "date_to_serial", "days_ago", "display_date",
    "month_label", "norm_year", "parse_class_year", "parse_date", "serial_to_date", "first_name",
    "form_name_to_display", "last_name", "display_name", "name_distance", "name_key", "name_parts",
    "parts_distance", "single_name", "split_names", "strip_rank", "title_case", "bigrams", "cosine", "dice",
    "numbered_bigrams", "set_dice", "unit_vector", "collapse", "emails_in", "filename_key", "fill_template", "form_id",
    "is_email", "name_from_address", "name_likeness", "norm_text", "parse_filename", "split_camel",
]
