"""Names of facilities and places: cleaning, words, search keys, and what a name stands for.

Patterns and word lists are parameters, so that a deployment brings its own as data.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm

#: A code of a sponsor beside a name: "( Site 0087)", "/ID# 12345", "Local Institution - 0012".
SITE_CODE = r"(?i)\(\s*site\s*[#\w-]*\s*\)|/\s*id#?\s*\d+|\blocal institution\s*-\s*\d+"
CODE_ONLY = r"(?i)^\s*(?:study\s+)?(?:site|center|centre|location)?[\s#:.-]*(?:[A-Z]{0,3}[\s-]?)?\d[\dA-Z-]*\s*$"


def without_codes(c: Column, codes: str = SITE_CODE) -> Column:
    """``norm`` of a name without a sponsor's codes."""
    return norm(F.regexp_replace(c, codes, " "))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s,/-]+|[\s,/-]+$", "")


def clean_name(c: Column, codes: str = SITE_CODE) -> Column:
    """A name to show (X2): codes, empty brackets and stray marks taken out, and brackets balanced.

    A bracket that closes nothing goes; those that stay open are closed at the end, or go where nothing follows
    them. A name of which nothing stays is shown as it came.
    """
    y = F.trim(F.regexp_replace(F.regexp_replace(c, codes, ""), r"\s+", " "))
    y = _trimmed(F.regexp_replace(_trimmed(y), r"\(\s*\)", ""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("open"))

    def step(acc, ch):
        stray = (ch == ")") & (acc["open"] == 0)
        depth = acc["open"] + F.when(ch == "(", 1).when((ch == ")") & ~stray, -1).otherwise(0)
        return F.struct(F.when(stray, acc["out"]).otherwise(F.concat(acc["out"], ch)).alias("out"), depth.alias("open"))

    def finish(acc):
        dangling = F.regexp_extract(acc["out"], r"((?:\(\s*)+)$", 1)
        lost = F.least(F.length(F.replace(dangling, F.lit(" "), F.lit(""))), acc["open"])
        body = F.when(lost > 0, F.regexp_replace(acc["out"], r"(?:\(\s*)+$", "")).otherwise(acc["out"])
        return F.concat(_trimmed(body), F.repeat(F.lit(")"), acc["open"] - lost))

    out = F.aggregate(F.split(y, ""), start, step, finish)
    return F.when(out == "", c).otherwise(out)


def code_like(c: Column, pattern: str = CODE_ONLY) -> Column:
    """Whether a name is a code only."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def name_words(c: Column, short: dict[str, str] | None = None, stop: tuple[str, ...] = (), codes: str = SITE_CODE) -> Column:
    """Words of a name in order (X3): bracketed asides and codes out, single letters next to each other joined
    ("M. D." to "md"), short forms spelt out, filler words dropped."""
    y = F.regexp_replace(F.regexp_replace(c, codes, " "), r"\([^()]*\)", " ")
    y = F.regexp_replace(F.replace(F.lower(y), F.lit("&"), F.lit(" and ")), r"['’`]", "")
    y = F.trim(F.regexp_replace(y, r"[^a-z0-9]+", " "))
    y = F.regexp_replace(y, r"(?<=\b[a-z]) (?=[a-z]\b)", "")
    words = F.filter(F.split(y, " "), lambda w: w != "")
    if short:
        spelt = F.create_map(*(F.lit(x) for pair in short.items() for x in pair))
        words = F.transform(words, lambda w: F.coalesce(F.element_at(spelt, w), w))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def _folds() -> tuple[str, str]:
    """Letters with marks and their base letters, by rule: those whose canonical decomposition begins with one ASCII letter."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0x1F00)]
    kept = [(a, d[0]) for a, d in pairs if len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


_FROM, _TO = _folds()


def fold(c: Column) -> Column:
    """Lower case without marks on letters."""
    return F.lower(F.regexp_replace(F.translate(c, _FROM, _TO), "[̀-ͯ]", ""))


#: Words that a search key shortens.
SHORTER = (("sainte", "ste"), ("saint", "st"), ("mount", "mt"), ("fort", "ft"))


def search_key(c: Column) -> Column:
    """Letters and digits of a folded place name, with the usual short forms."""
    y = F.replace(fold(c), F.lit("&"), F.lit(" and "))
    for long, short in SHORTER:
        y = F.regexp_replace(y, rf"\b{long}\b", short)
    return F.regexp_replace(y, "[^a-z0-9]", "")


def place_names(name: Column, kind: Column, suffixes: dict[str, str], twice: Column | None = None, second: str = " town") -> Column:
    """Keys of a listed place (X10): its name in lower case without the legal description of its kind; where ``twice``
    holds, also without a ``second`` one, the longer form staying as an alias."""
    low = F.lower(name)
    end = F.element_at(F.create_map(*(F.lit(x) for pair in suffixes.items() for x in pair)), kind)
    main = F.when(end.isNotNull() & low.endswith(end), F.left(low, F.length(low) - F.length(end))).otherwise(low)
    if twice is None:
        return F.array(main)
    short = F.left(main, F.length(main) - len(second))
    return F.when(F.coalesce(twice, F.lit(False)) & main.endswith(second), F.array(short, main)).otherwise(F.array(main))


def categories(c: Column, rules: list[tuple[str, str]], blank: str | None = None, first: list[tuple[str, list[str]]] = ()) -> Column:
    """All categories (label, pattern) that a text names (X11), in the order of the rules.

    What ``blank`` matches is taken out before. Then the first pattern of ``first`` that matches keeps only its
    labels of those found; if it has one label, none of it was found and nothing was blanked, that label it is.
    """
    text = F.regexp_replace(c, blank, " ") if blank else c
    found = F.filter(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in rules)), lambda x: x.isNotNull())
    blanked = (text != c) if blank else F.lit(False)
    out = found
    for pattern, keep in reversed(list(first)):
        own = F.array(*map(F.lit, keep))
        hit = F.array_intersect(found, own)
        named = F.when((F.size(hit) == 0) & ~blanked, own).otherwise(hit) if len(keep) == 1 else hit
        out = F.when(text.rlike(pattern), named).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def combined_category(parts: Column, generic: Column, title: Column, kinds: dict[str, str], title_generic: Column, other_kind: Column) -> Column:
    """One category and its source from those of all texts of an item (X12), as struct(category, source).

    parts: labels that the item's own texts name; generic: whether one names only a group; title: labels that the title
    names; title_generic: whether the title names a group; other_kind: the kind (values of ``kinds``) that a group
    named in the texts stands for, if any. Two labels are ``multi``; one with a group of the other kind, or beside a
    group that the title names while it doesn't name the label, or where the title names more, is ``multi``; one is
    itself; a group alone is ``multi``; else the title decides the same way, and what is left is ``unclassified``.
    """
    told = lambda c, s: F.struct(F.lit(c).alias("category") if isinstance(c, str) else c.alias("category"), F.lit(s).alias("source"))
    label = F.get(parts, F.lit(0))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), label)
    more = F.size(F.array_except(title, parts)) > 0
    return (
        F.when(F.size(parts) >= 2, told("multi", "texts"))
        .when((F.size(parts) == 1) & other_kind.isNotNull() & (other_kind != kind), told("multi", "texts"))
        .when((F.size(parts) == 1) & generic & title_generic & ~F.array_contains(title, label), told("multi", "texts and title"))
        .when((F.size(parts) == 1) & generic & more, told("multi", "texts and title"))
        .when(F.size(parts) == 1, told(label, "texts"))
        .when(generic, told("multi", "texts"))
        .when(F.size(title) == 1, told(F.get(title, F.lit(0)), "title"))
        .when((F.size(title) >= 2) | title_generic, told("multi", "title"))
        .otherwise(told("unclassified", "none"))
    )


def by_evidence(texts: list[tuple[str, Column]], yes: str, no: str, blank: str, stems: Column | None = None, endings: tuple[str, ...] = ()) -> Column:
    """``yes``, ``no`` or ``unknown`` with its evidence, as struct(answer, evidence).

    First a word of ``stems`` with one of the endings, of over six letters; then the first text in which ``yes``
    matches once ``blank`` is taken out; then ``no`` in any of them.
    """
    told = lambda a, e: F.struct(F.lit(a).alias("answer"), e.alias("evidence") if isinstance(e, Column) else F.lit(e).alias("evidence"))
    rules: list[tuple[Column, Column]] = []
    if stems is not None and endings:
        words = F.filter(F.split(F.regexp_replace(F.lower(stems), r"[()\[\],;/]", " "), r"\s+"), lambda w: (F.length(w) > 6) & w.rlike("(?:" + "|".join(endings) + ")$"))
        rules.append((F.size(words) > 0, told("yes", F.concat(F.lit("stem:"), F.get(words, F.lit(0))))))
    clean = [(name, F.regexp_replace(F.coalesce(c, F.lit("")), blank, " ")) for name, c in texts]
    rules += [(c.rlike(yes), told("yes", name)) for name, c in clean]
    rules.append((F.concat_ws(" ", *(c for _, c in clean)).rlike(no), told("no", "stated")))
    return F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), out) for cond, out in rules), told("unknown", "none"))


def stands_for(c: Column, rules: list[tuple[str, str]], institution: str, credentials: tuple[str, ...] = ("md", "do", "phd", "rn")) -> Column:
    """What a facility's name stands for, null for an institution.

    A name without a letter is a placeholder. The first rule (kind, pattern) that matches tells, unless what is left
    of the name without the match names an institution. Two to four words before a credential, none of them an
    institution's, are a person.
    """
    bare = F.trim(F.regexp_replace(c, r"\([^()]*\)|[()]", " "))
    person = rf"(?i)^(?:dr\.?\s+)?[a-z][a-z'.\-]*(?:\s+[a-z][a-z'.\-]*){{1,3}},?\s+(?:{'|'.join(credentials)})\.?$"
    told = [F.when(bare.rlike(p) & ~F.regexp_replace(bare, p, " ").rlike(institution), F.lit(kind)) for kind, p in rules]
    return F.when(~F.coalesce(bare, F.lit("")).rlike("[A-Za-z]"), "placeholder").otherwise(F.coalesce(*told, F.when(bare.rlike(person) & ~bare.rlike(institution), "person")))


def screened(c: Column, blank: str, inside: list[tuple[str, str]], keep: str) -> Column:
    """Whether a text still matches ``keep`` once ``blank`` is taken out, and, for each (context, word) whose context the
    text has, that word too (F16)."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), blank, " ")
    for context, word in inside:
        text = F.when(c.rlike(context), F.regexp_replace(text, word, " ")).otherwise(text)
    return text.rlike(keep)
