"""Text functions as Column expressions.

Everything here is a JVM-side expression. The one Python piece of the
cleaning step (X1, HTML unescape) is a vectorised pandas UDF over the few texts that need it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the pre-tokenising pattern of the reference tokenizer
# (specials, contractions, letter runs, single digits, other runs).
PRETOKEN_PATTERN = (r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|"
                    r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

# Python's \s is Unicode-aware; Java's and RE2's are ASCII. This class is
# what Python calls whitespace (ASCII space/controls, U+001C-U+001F, U+0085
# and the Unicode separators).
WHITESPACE_CLASS = r"[\t\n\x0B\f\r \x1C-\x1F\x85\p{Z}]"

# Start and end ids of the published vocabulary, and the default context length.
# For other vocabularies pass the ids that ``operators.tokens.special_ids`` derives.
SOT_ID, EOT_ID, CONTEXT_LENGTH = 49406, 49407, 77

# The pre-tokens of a text whose white space is still as it came: all of ``WHITESPACE_CLASS`` parts tokens. Letter runs
# stand first, since no other token begins with a letter.
_IN_TEXT = (r"\p{L}++|\p{N}|<\|startoftext\|>|<\|endoftext\|>|'(?:s|t|re|ve|m|ll|d)|"
            r"[^\s\x1C-\x1F\x85\p{Z}\p{L}\p{N}]++")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def whitespace_clean(text) -> Column:
    """Runs of whitespace -> one space, then strip."""
    return F.trim(F.regexp_replace(_c(text), WHITESPACE_CLASS + "+", " "))


def pretokenize(text) -> Column:
    """Lower-case, then contractions, letter runs, single digits, other runs."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(PRETOKEN_PATTERN), 0)


def clean_for_tokens(text) -> Column:
    """The text the tokenizer sees: whitespace-cleaned and lower-cased."""
    return F.lower(whitespace_clean(text))


def tokens(text) -> Column:
    """The tokens of a text, the one way into every token job; none for null and blank texts."""
    return F.coalesce(F.regexp_extract_all(F.lower(basic_clean(text)), F.lit(_IN_TEXT), 0), F.array().cast("array<string>"))


def strip(text) -> Column:
    """White space off both ends (the class Python strips)."""
    c = _c(text)
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))  # most texts have none, and need no pass over all characters
    return F.when(ends.rlike(WHITESPACE_CLASS), F.regexp_replace(c, f"^{WHITESPACE_CLASS}++|(?<!{WHITESPACE_CLASS}){WHITESPACE_CLASS}++$", "")).otherwise(c)


# UTF-8 byte sequences read as latin-1 or windows-1252 characters, e.g. 'Ã©' for 'é', 'â€™' for an apostrophe.
# Lead bytes are the same letters in both; a byte that follows is a latin-1 character or one of windows-1252's own.
_OWN_1252 = "".join(bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0))
_FOLLOWS = rf"[\u0080-\u00BF{_OWN_1252}]"
_MARKED = (rf"[&\u00C2-\u00F4](?:(?<=&)[#A-Za-z]|(?<=[\u00C2-\u00DF]){_FOLLOWS}|(?<=[\u00E0-\u00EF]){_FOLLOWS}{{2}}|"
           rf"(?<=[\u00F0-\u00F4]){_FOLLOWS}{{3}})")  # an entity or one of MOJIBAKE, told by its first character
MOJIBAKE = rf"[\u00C2-\u00DF]{_FOLLOWS}|[\u00E0-\u00EF]{_FOLLOWS}{{2}}|[\u00F0-\u00F4]{_FOLLOWS}{{3}}"
#: Leads of Latin letters, punctuation and emoji. Behind other letters a printable character may well be itself ("CAFÉ…", "«É»").
_PLAIN_LEADS = "ÂÃâãïð"


def repair(text: str) -> str:
    """Undo UTF-8 read as latin-1 or windows-1252, level by level until nothing changes.

    A sequence is replaced if its bytes decode and it has one of the plain leads, holds a control character, or stands
    beside another sequence that decodes.
    """
    byte_of = {ord(c): c.encode("cp1252")[0] for c in _OWN_1252}
    runs, one = re.compile(f"(?:{MOJIBAKE})+"), re.compile(MOJIBAKE)

    def decoded(seq: str) -> str | None:
        try:
            return bytes(byte_of.get(ord(c), ord(c)) for c in seq).decode("utf-8")
        except UnicodeDecodeError:
            return None

    def undo(run: re.Match) -> str:
        parts = one.findall(run[0])
        new = [decoded(x) for x in parts]
        several = sum(x is not None for x in new) > 1
        sure = lambda x: several or x[0] in _PLAIN_LEADS or any("\x80" <= c <= "\x9f" for c in x)
        return "".join(y if y is not None and sure(x) else x for x, y in zip(parts, new, strict=True))

    while (better := runs.sub(undo, text)) != text:
        text = better
    return text


def unescaper() -> Callable[[str], str]:
    """X1 as a Python function of one text."""
    return lambda x: html.unescape(html.unescape(repair(x))).strip()


def _clean_marked(s: pd.Series) -> pd.Series:
    one = unescaper()
    return s.map(lambda x: None if x is None else one(x))


def basic_clean(text) -> Column:
    """Repair UTF-8 that was read as latin-1 or windows-1252 (any number of times), HTML-unescape twice, strip.

    Only texts that hold an entity or a double-encoded sequence go to Python (the standard
    library knows all entity names); the others are stripped in the JVM.
    """
    c = _c(text)
    marked = F.when(c.rlike(_MARKED), c)
    return F.coalesce(F.pandas_udf(_clean_marked, StringType())(marked), strip(c))


def _code_point(b: Column) -> Column:
    """Code point of the printable symbol standing for byte ``b``.

    The rule: bytes 33-126, 161-172 and 174-255 stand for themselves; the
    other 68 bytes map, in byte order, to code points 256, 257, ... 323.
    """
    own = ((b >= 33) & (b <= 126)) | ((b >= 161) & (b <= 172)) | ((b >= 174) & (b <= 255))
    return F.when(own, b).when(b <= 32, b + 256).when(b <= 160, b - 127 + 289).otherwise(F.lit(323))


def _utf8_hex(cp: Column) -> Column:
    """UTF-8 bytes (hex) of a code point below 2048."""
    two = F.concat(F.hex(F.lit(192) + F.floor(cp / 64)), F.hex(F.lit(128) + F.pmod(cp, F.lit(64))))
    return F.when(cp < 128, F.lpad(F.hex(cp), 2, "0")).otherwise(two)


def byte_symbols(token) -> Column:
    """UTF-8 bytes of ``token`` as printable symbols, one per byte (reversible).

    Staged transforms so each byte value and code point is computed once.
    """
    hexes = F.regexp_extract_all(F.hex(F.encode(_c(token), "UTF-8")), F.lit("(..)"), 1)
    byte_vals = F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("int"))
    cps = F.transform(byte_vals, _code_point)
    return F.decode(F.unhex(F.array_join(F.transform(cps, _utf8_hex), "")), "UTF-8")


def byte_table() -> list[tuple[int, str]]:
    """X4 on the driver: (byte, symbol) in the reference vocabulary order."""
    own = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    rest = [b for b in range(256) if b not in set(own)]
    return [(b, chr(b)) for b in own] + [(b, chr(256 + i)) for i, b in enumerate(rest)]


def symbols(sym_str) -> Column:
    """Split a symbol string into single characters."""
    return F.regexp_extract_all(_c(sym_str), F.lit("(?s)(.)"), 1)


def word_symbols(sym_str) -> Column:
    """Symbols of a word with the end-of-word mark on the last one (one regex pass)."""
    return F.regexp_extract_all(F.concat(_c(sym_str), F.lit("</w>")), F.lit("(?s)(.(?:</w>$)?)"), 1)


def tokenize_fixed(ids, length: int = CONTEXT_LENGTH, truncate: bool = False,
                   sot: int = SOT_ID, eot: int = EOT_ID) -> Column:
    """Start + ids + end, zero-padded to ``length``.

    Too long: error, or (``truncate``) cut with the end id kept last.
    """
    full = F.concat(F.array(F.lit(sot).cast("long")), _c(ids).cast("array<long>"), F.array(F.lit(eot).cast("long")))
    too_long = F.size(full) > length
    if truncate:
        cut = F.concat(F.slice(full, 1, length - 1), F.array(F.lit(eot).cast("long")))
    else:
        cut = F.raise_error(F.lit(f"input is too long for context length {length}")).cast("array<long>")
    fitted = F.when(too_long, cut).otherwise(full)
    return F.concat(fitted, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(length) - F.size(fitted),
                                                                              F.lit(0))))


def truncate_ids(ids, max_len: int) -> Column:
    """X10 first step: keep at most ``max_len`` ids."""
    return F.slice(_c(ids), 1, max_len)


def pad_to(ids, width, pad_id: int) -> Column:
    """Right-pad an ids array to ``width`` (a Column or int) with ``pad_id``."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(_c(ids), F.array_repeat(F.lit(pad_id).cast("long"), F.greatest(w - F.size(_c(ids)), F.lit(0))))


def round_up(width: Column, multiple: int | None) -> Column:
    if not multiple:
        return width
    return (F.ceil(width / F.lit(multiple)) * F.lit(multiple)).cast("int")


def attention_mask(ids, pad_id: int) -> Column:
    """X11: 1 where id != pad."""
    return F.transform(_c(ids), lambda x: F.when(x != pad_id, 1).otherwise(0))


def _u32(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def mlm_mask(ids, row_id, seed: int, mask_id: int, vocab_size: int, n_special: int = 3,
             p: float = 0.15) -> tuple[Column, Column]:
    """Choose ``p`` of the non-special tokens; of these 80 % mask, 10 % random, 10 % kept.

    Draws are md5 of ``row:pos:seed:k``, so the result does not depend on
    partitioning. Returns (input_ids, labels); labels are -100 where not chosen.
    """
    rid = _c(row_id).cast("string")

    def draw(i, k):
        return _u32(F.concat_ws(":", rid, i.cast("string"), F.lit(str(seed)), F.lit(k))) / F.lit(4294967296.0)

    def rnd(i):
        return F.pmod(_u32(F.concat_ws(":", rid, i.cast("string"), F.lit(str(seed)), F.lit("r"))),
                      F.lit(vocab_size)) + F.lit(n_special)

    a = _c(ids).cast("array<long>")
    chosen = lambda x, i: (x >= n_special) & (draw(i, "c") < p)
    new_ids = F.transform(a, lambda x, i: F.when(chosen(x, i), F.when(draw(i, "m") < 0.8, F.lit(mask_id).cast("long"))
                                                 .when(draw(i, "m") < 0.9, rnd(i)).otherwise(x)).otherwise(x))
    labels = F.transform(a, lambda x, i: F.when(chosen(x, i), x).otherwise(F.lit(-100).cast("long")))
    return new_ids, labels


def camel_to_snake(s) -> Column:
    """MeanPooler -> mean_pooler."""
    return F.lower(F.regexp_replace(_c(s), r"(?<!^)(?=[A-Z])", "_"))


def prompt(col, template: str = "a photo of a {}.") -> Column:
    """Fill a template with a column value."""
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), _c(col), F.lit(after))


def file_name(path) -> Column:
    """Last path part."""
    return F.element_at(F.split(_c(path), "/"), -1)


def file_ext(path) -> Column:
    """Extension after the last dot of the file name ('' when none)."""
    return F.regexp_extract(file_name(path), r"\.([^./]*)$", 1)


def file_stem(path) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^./]*$", "")


def cut_chars(s, n: int = 5) -> Column:
    """Drop the last ``n`` characters (the reference drops '.json')."""
    c = _c(s)
    return c.substr(F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))


def fingerprint(*parts) -> Column:
    """Cache key from the settings that define a prepared dataset."""
    return F.concat_ws("_", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
