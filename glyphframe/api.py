"""All public verbs in one namespace."""

from glyphframe.functions.patterns import Pattern, as_pattern, boundary, coll, fixed, opts, regex, type_of
from glyphframe.functions.runtime import icu_info
from glyphframe.operators.casing import str_to_camel, str_to_kebab, str_to_lower, str_to_sentence, str_to_snake, str_to_title, str_to_upper, to_words
from glyphframe.operators.combine import str_c, str_flatten, str_flatten_comma, str_glue, str_glue_data, str_interp
from glyphframe.operators.detect import like_to_regex, str_detect, str_ends, str_equal, str_ilike, str_like, str_starts, str_subset, str_which
from glyphframe.operators.encoding import enc_get, enc_info, escape_unicode, str_conv, str_encode, str_escape, trans_nfc
from glyphframe.operators.extract import simplify, str_extract, str_extract_all, str_match, str_match_all
from glyphframe.operators.layout import str_dup, str_length, str_pad, str_squish, str_trim, str_width, str_wrap
from glyphframe.operators.locate import invert_match, str_count, str_locate, str_locate_all
from glyphframe.operators.ordering import natural_key, str_duplicated, str_order, str_rank, str_sort, str_unique
from glyphframe.operators.positions import str_reverse, str_sub, str_sub_all, str_sub_replace, str_sub_replace_all, str_trunc
from glyphframe.operators.replace import per_batch, replace_charclass, str_remove, str_remove_all, str_replace, str_replace_all, str_replace_na
from glyphframe.operators.split import split_lines, str_split, str_split_1, str_split_fixed, str_split_i, word
from glyphframe.operators.view import highlighted, str_view, str_view_all
from glyphframe.sources.text import read_lines, read_raw, scan_lines

str_read_lines = read_lines

__all__ = [name for name in dir() if not name.startswith("_")]
