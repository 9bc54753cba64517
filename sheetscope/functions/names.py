"""Identifiers and name matching, as column expressions.

Names of tables and columns are metadata and go through the ``*_name`` helpers on
the driver; the same rules over data values are the ``Column`` functions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode blocks whose compatibility decompositions are folded: Latin to symbols,
# ligatures, and the half- and full-width forms.
_FOLDED_BLOCKS = (range(0xA0, 0x3400), range(0xFB00, 0xFB50), range(0xFE30, 0xFFF0))


def _folded(ch: str) -> str:
    """One character without its marks, in its plain form."""
    return "".join(part for part in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(part))


def fold_name(text: str) -> str:
    """Plain letters for accented ones, ligatures and wide forms, by the table that values use."""
    source, target, longer = _fold_table()
    return text.translate(str.maketrans(source[: len(target)], target, source[len(target) :]) | str.maketrans(longer))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one, the ones they fold to, and the longer folds.

    Marks that vanish go to the end of the source string, where ``translate``
    deletes them.
    """
    single: dict[str, str] = {}
    gone: list[str] = []
    longer: dict[str, str] = {}
    for block in _FOLDED_BLOCKS:
        for code in block:
            ch = chr(code)
            folded = _folded(ch)
            if folded == ch:
                continue
            if not folded:
                gone.append(ch)
            elif len(folded) == 1:
                single[ch] = folded
            else:
                longer[ch] = folded
    return "".join(single) + "".join(gone), "".join(single.values()), longer


def fold(col: Column) -> Column:
    """``fold_name`` over values: plain ASCII is passed through untouched."""
    source, target, longer = _fold_table()
    one_to_one = F.translate(col, source, target)
    pairs = F.str_to_map(
        F.lit("\x01".join(f"{ch}\x02{folded}" for ch, folded in longer.items())), F.lit("\x01"), F.lit("\x02")
    )
    one_to_many = F.array_join(
        F.transform(F.split(one_to_one, ""), lambda ch: F.coalesce(F.try_element_at(pairs, ch), ch)),
        "",
    )
    has_longer = F.translate(col, "".join(longer), "") != col
    return F.when(col.rlike(r"^[\x00-\x7F]*$"), col).when(has_longer, one_to_many).otherwise(one_to_one)


def match_key(col: Column) -> Column:
    """Accent- and case-blind key: equal keys are the same name."""
    return F.lower(fold(col))


def match_key_name(text: str) -> str:
    return fold_name(text).lower()


def safe_id(col: Column, prefix: str) -> Column:
    """Identifier for storage: no accents, whitespace runs become one underscore."""
    joined = F.regexp_replace(fold(col), r"(?U)\s+", "_")
    return F.when((joined == "") | joined.rlike(r"^\p{Nd}"), F.concat(F.lit(prefix), joined)).otherwise(joined)


def safe_id_name(text: str, prefix: str) -> str:
    joined = re.sub(r"\s+", "_", fold_name(text))
    return prefix + joined if not joined or joined[0].isdigit() else joined


def safe_table_name(text: str) -> str:
    return safe_id_name(text, "Table_")


def safe_column_name(text: str) -> str:
    return safe_id_name(text, "Col_")


def safe_column_names(names: list[str]) -> list[str]:
    """A safe identifier for each name; those that fold to one get a number after it."""
    out: list[str] = []
    for name in names:
        safe, n = safe_column_name(name), 1
        taken = {o.lower() for o in out}
        while (own := safe if n == 1 else f"{safe}_{n}").lower() in taken:
            n += 1
        out.append(own)
    return out


def compact_token(col: Column) -> Column:
    """ASCII letters and digits joined by single underscores."""
    token = F.btrim(F.regexp_replace(fold(col), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.when(token == "", F.lit("Col")).otherwise(token)


def compact_token_name(text: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "_", fold_name(text)).strip("_") or "Col"


def search_token(col: Column) -> Column:
    """Letters, digits and underscores only, in lower case."""
    return F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}_]", ""))


def contains_any(col: Column, words: tuple[str, ...]) -> Column:
    """True when one of ``words`` occurs anywhere in ``col``."""
    return col.rlike("|".join(re.escape(word) for word in words))
