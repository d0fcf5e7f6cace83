"""Text rules: path redaction, log scrubbing, phrase scan with negation (one regular expression each), scan for many strings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import fixed

# Letters and digits of any script count as word characters.
UNICODE = "(?U)"


def redact_paths(text: Column) -> Column:
    """Absolute paths, then data file names, replaced by a placeholder."""
    # Cheap tests first: most texts hold neither a slash nor a data file ending.
    slashed = F.contains(text, F.lit("/")) | text.rlike(r"[A-Za-z]:\\")
    once = F.when(slashed, F.regexp_replace(text, UNICODE + fixed.ABSOLUTE_PATH, fixed.REDACTED_PATH)).otherwise(text)
    named = once.rlike(r"(?i)\.(?:csv|tsv|parquet|feather|xls|json|pkl|npy|npz)")
    return F.when(named, F.regexp_replace(once, UNICODE + fixed.DATA_FILE, fixed.REDACTED_PATH)).otherwise(once)


def scrub_log(text: Column) -> Column:
    """Last exception line (else last line), quotes and paths hidden, cut to the limit."""
    lines = F.filter(
        F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != ""
    )
    errors = F.filter(lines, lambda s: s.rlike(fixed.EXCEPTION_LINE))
    chosen = F.coalesce(F.try_element_at(errors, F.lit(-1)), F.try_element_at(lines, F.lit(-1)), F.lit(""))
    hidden = F.regexp_replace(chosen, fixed.QUOTED, fixed.REDACTED_VALUE)
    return F.substring(redact_paths(hidden), 1, fixed.SCRUB_LIMIT)


def _java(text: str) -> str:
    return "\\Q" + text + "\\E"


def undenied_pattern(
    phrases: Sequence[str], cues: Sequence[str] = fixed.NEGATION_CUES,
    denials: Sequence[str] = fixed.DENYING_PREDICATES, window: int = fixed.NEGATION_WINDOW,
) -> str:
    """Pattern that matches a phrase unless its own clause denies it.

    A cue that ends before the phrase, or a denying predicate after it, counts when it lies inside the
    window with no clause break between. The phrase is matched first, so the look-arounds run only there.
    """
    inside = "[^" + fixed.CLAUSE_BREAK[1:]
    before = "|".join(f"{_java(c)}{inside}{{0,{window - len(c)}}}" for c in cues)
    after = "|".join(f"{inside}{{0,{window - len(d)}}}{_java(d)}" for d in denials)
    return "|".join(
        f"{_java(p)}(?<!(?:{before}){_java(p)})(?!{after})" if after else f"{_java(p)}(?<!(?:{before}){_java(p)})"
        for p in phrases
    )


def undenied(text: Column, phrases: Sequence[str], **rules) -> Column:
    """True when any phrase occurs at least once without a denial; ``text`` must be lower case."""
    return text.rlike(undenied_pattern(phrases, **rules))


def claims(text: Column, phrases: dict[str, Sequence[str]] | None = None) -> Column:
    """Sorted names whose phrases the text uses undenied."""
    found = [
        F.when(undenied(F.lower(text), group), F.lit(name))
        for name, group in sorted((phrases or fixed.CLAIM_PHRASES).items())
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def private_forms(terms: Sequence[str]) -> list[str]:
    """Strings no text may hold: each term as given, with forward slashes, and its file name."""
    forms: set[str] = set()
    for term in terms:
        slashed = term.replace("\\", "/")
        forms |= {term, slashed, re.split(r"/", slashed)[-1]}
    return sorted(f for f in forms if len(f) >= fixed.PRIVATE_MIN_CHARS)


# Up to this many strings are looked for one by one in generated code; more go through one automaton. Results are the same.
FEW_TERMS = 8
# The registered list travels with every task: a longer one (characters of all strings) is refused.
MOST_TERM_CHARS = 50_000_000


@lru_cache(maxsize=2)
def _automaton(forms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for form in forms:
        found.add_word(form, form)
    found.make_automaton()
    return found


def _checked_forms(terms: Sequence[str]) -> tuple[str, ...]:
    forms = tuple(private_forms(terms))
    if sum(map(len, forms)) > MOST_TERM_CHARS:
        raise ValueError(f"registered strings of more than {MOST_TERM_CHARS} characters")
    return forms


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """Registered strings that the text contains, distinct and sorted (null for a null text).

    One pass over the text for any number of strings, overlapping and nested ones included.
    """
    forms = _checked_forms(terms)

    def hits(texts: pa.Array) -> pa.Array:
        scan = _automaton(forms)
        return pa.array([None if (t := x.as_py()) is None else sorted({form for _, form in scan.iter(t)}) if forms else [] for x in texts], pa.list_(pa.string()))

    return F.arrow_udf(hits, "array<string>")(text)


def holds_private(text: Column, terms: Sequence[str]) -> Column:
    """True when a registered string is contained (null for a null text, if any string is registered)."""
    forms = _checked_forms(terms)
    if len(forms) > FEW_TERMS:

        def any_hit(texts: pa.Array) -> pa.Array:
            scan = _automaton(forms)
            return pa.array([None if (t := x.as_py()) is None else next(scan.iter(t), None) is not None for x in texts], pa.bool_())

        return F.arrow_udf(any_hit, "boolean")(text)
    out = F.lit(False)
    for form in forms:
        out = out | F.contains(text, F.lit(form))
    return out
