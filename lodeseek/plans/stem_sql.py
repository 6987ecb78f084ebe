"""The stemmer as DuckDB SQL over a table of distinct words, to check stems by."""

from __future__ import annotations

from ..functions import stem

_V = "[aeiouy]"
_N = "[^aeiouy]"


def _quoted(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def _short(w: str) -> str:
    return f"regexp_matches({w}, '{_N}{_V}[^aeiouywxY]$|^{_V}{_N}$')"


def _first_of(endings, rule) -> str:
    """The rule of the first ending that a word has; the word itself without one."""
    return "CASE " + " ".join(f"WHEN ends_with(w, '{e}') THEN {rule(e)}" for e in endings) + " ELSE w END"


def _swap(table, more) -> str:
    new = dict(table)

    def rule(e: str) -> str:
        at = f"length(w) - {len(e)}"
        return f"CASE WHEN {at} >= r1{more(e, at)} THEN left(w, {at}) || '{new[e]}' ELSE w END"

    return _first_of([e for e, _ in table], rule)


def stems(words: str, name: str = "stems") -> str:
    """CTEs that end in name(word, stem), from a CTE words(word) of lower-case words of letters and digits."""
    two = lambda e, at: f" AND right(left(w, {at}), 1) = 'l'" if e == "ogi" else f" AND regexp_matches(left(w, {at}), '[cdeghkmnrt]$')" if e == "li" else ""
    three = lambda e, at: f" AND {at} >= r2" if e == "ative" else ""
    four = lambda e: f"CASE WHEN length(w) - {len(e)} >= r2" + (f" AND regexp_matches(left(w, length(w) - {len(e)}), '[st]$')" if e == "ion" else "") + f" THEN left(w, length(w) - {len(e)}) ELSE w END"
    special = " ".join(f"WHEN a.word = '{a}' THEN '{b}'" for a, b in sorted(stem._SPECIAL.items()))
    keep, after = _quoted(stem._KEEP), _quoted(stem._AFTER_1A)
    e = name + "_"
    return f"""
{e}0 AS MATERIALIZED (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({_V})y', '\\1Y', 'g') AS w, regexp_extract(word, '^(gener|commun|arsen)', 1) AS head FROM {words}),
{e}1 AS MATERIALIZED (SELECT word, w, CASE WHEN head <> '' THEN length(head) WHEN regexp_matches(w, '{_V}{_N}') THEN length(regexp_extract(w, '^.*?{_V}{_N}')) ELSE length(w) END AS r1 FROM {e}0),
{e}2 AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{_V}{_N}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?{_V}{_N}')) ELSE length(w) END AS r2 FROM {e}1),
{e}3 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
  WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
  WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '{_V}.+s$') THEN left(w, length(w) - 1) ELSE w END AS w) FROM {e}2),
{e}4 AS MATERIALIZED (SELECT *, w AS w4, w IN {after} AS done, regexp_extract(w, '(ingly|edly|ing|ed)$', 1) AS gone, regexp_extract(w, '(eedly|eed)$', 1) AS eed FROM {e}3),
{e}5 AS MATERIALIZED (SELECT *, eed = '' AND gone <> '' AND regexp_matches(left(w, length(w) - length(gone)), '{_V}') AND NOT done AS cut FROM {e}4),
{e}6 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN done THEN w WHEN eed <> '' THEN CASE WHEN length(w) - length(eed) >= r1 THEN left(w, length(w) - length(eed)) || 'ee' ELSE w END
  WHEN cut THEN left(w, length(w) - length(gone)) ELSE w END AS w) FROM {e}5),
{e}7 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - 1)
  WHEN r1 >= length(w) AND {_short("w")} THEN w || 'e' ELSE w END AS w) FROM {e}6),
{e}8 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN length(w) > 2 THEN regexp_replace(w, '({_N})[yY]$', '\\1i') ELSE w END AS w) FROM {e}7),
{e}9 AS MATERIALIZED (SELECT * REPLACE ({_swap(stem._STEP2, two)} AS w) FROM {e}8),
{e}10 AS MATERIALIZED (SELECT * REPLACE ({_swap(stem._STEP3, three)} AS w) FROM {e}9),
{e}11 AS MATERIALIZED (SELECT * REPLACE ({_first_of(stem._STEP4, four)} AS w) FROM {e}10),
{e}12 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {_short("left(w, length(w) - 1)")})) THEN left(w, length(w) - 1)
  WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w) FROM {e}11),
{name} AS (SELECT a.word, CASE WHEN length(a.word) <= 2 THEN a.word {special} WHEN a.word IN {keep} THEN a.word
  WHEN a.done THEN a.w4 ELSE lower(a.w) END AS stem FROM {e}12 a)"""
