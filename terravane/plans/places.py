"""Search for places by name (M6): exact names first, misspellings only where nothing matched, and rules for namesakes.

The index is a table (kind, table, id, name, key, state, score): a row for each name that a place goes by. One question is a
filter on its key; only matches, and for a misspelt question the candidates within a few letters, come to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import _FROM, _TO, SHORTER, search_key
from ..functions.text import one_edit

#: How strong a way of being found is, by kind (fixed values); misspellings come last.
STRENGTH = {"county": 0, "district": 0, "state": 0, "zip": 1, "town": 2, "member": 3, "senator": 3, "center": 3}
MISSPELT = 5
#: A namesake so many times larger than every other is taken; a town already at the smaller number.
DOMINANT, DOMINANT_TOWN = 20, 5
UNIT = re.compile(r"(?i)\s+(?:county|parish|borough|census area|municipality)$")


def key_of(text: str) -> str:
    """``search_key`` of a question, on the driver."""
    y = text.translate(str.maketrans(_FROM, _TO)).lower().replace("&", " and ")
    for long, short in SHORTER:
        y = re.sub(rf"\b{long}\b", short, y)
    return re.sub("[^a-z0-9]", "", y)


def index(places: DataFrame) -> DataFrame:
    """The index of places (kind, table, id, name, state, score)."""
    return places.select("kind", "table", "id", "name", "state", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), search_key(F.col("name")).alias("key"))


def read_question(question: str, states: dict[str, str]) -> tuple[str, str | None, bool]:
    """(name, state, whether only a county can be meant) of a question; states: by lower-case name or code, the code.

    The state stands after a comma, or is the last one to three words; as two letters these must be upper case.
    """
    text, state = question.strip(), None
    known = lambda s: states.get(s.strip().lower())
    if "," in text and known(text.rsplit(",", 1)[1]):
        text, end = text.rsplit(",", 1)
        state = known(end)
    elif not known(text):
        words = text.split()
        for n in range(min(3, len(words) - 1), 0, -1):
            end = " ".join(words[-n:])
            if known(end) and (n > 1 or len(end) != 2 or end.isupper()):
                text, state = " ".join(words[:-n]), known(end)
                break
    return UNIT.sub("", text.strip()), state, bool(UNIT.search(text.strip()))


def _misspelt(names: DataFrame, key: str) -> DataFrame:
    """Names one edit from a key, or two from one of over five letters, with how many."""
    near = F.when(one_edit(F.col("key"), F.lit(key)), 1)
    if len(key) > 5:
        near = near.when(F.levenshtein("key", F.lit(key), 2).between(0, 2), 2)
    close = names.where(F.abs(F.length("key") - len(key)) <= 2).withColumn("edits", near).where("edits is not null")
    least = close.agg(F.min("edits")).head()[0]
    return close.where(F.col("edits") == least) if least is not None else close.limit(0)


def find(names: DataFrame, question: str, states: dict[str, str], kind: str | None = None, state: str | None = None, limit: int = 10) -> dict:
    """{matches, ambiguous, others?} of a question, the best first; limit is at most 10.

    One match is it. A state's own name wins over all. Else the largest is taken if it has 20 times the score of every
    other (a town 5 times), no center among them; else it is ambiguous. A place found in several ways counts once, by the
    strongest.
    """
    name, told, county = read_question(question, states)
    state = states.get((state or "").lower(), state) or told
    key = key_of(name)
    if not key:
        return {"error": "a search needs a name", "hint": "a name, a name and a state, or a code"}
    own = names.where(F.col("kind") == kind) if kind else names
    own = own.where(F.col("kind") == "county") if county else own
    own = own.where(F.col("state") == state) if state else own
    most = max(1, min(10, limit))
    rank = F.create_map(*(F.lit(x) for k, v in STRENGTH.items() for x in (k, v)))
    way = F.coalesce(F.element_at(rank, F.col("kind")), F.lit(4))
    best = F.min(F.struct("way", (-F.col("score")).alias("s"), "kind", "name", "state"))

    def taken(df: DataFrame, how: str) -> list[dict]:
        found = df.withColumn("way", way if how == "exact" else F.lit(MISSPELT)).groupBy("table", "id").agg(best.alias("b"))
        rows = found.select("table", "id", "b.kind", "b.name", "b.state", (-F.col("b.s")).alias("score"), F.lit(how).alias("how"))
        return [r.asDict() for r in rows.orderBy(F.desc("score"), "name", "id").limit(most + 1).collect()]

    rows = taken(own.where(F.col("key") == key), "exact") or taken(_misspelt(own, key), "misspelt")
    if len(rows) <= 1:
        return {"matches": rows, "ambiguous": False}
    named = [r for r in rows if r["kind"] == "state" and r["how"] == "exact"]
    top, rest = (named[0], [r for r in rows if r is not named[0]]) if named else (rows[0], rows[1:])
    times = DOMINANT_TOWN if top["kind"] == "town" else DOMINANT
    wins = top["score"] > 0 and all(top["score"] >= times * r["score"] for r in rest) and all(r["kind"] != "center" for r in rows)
    if named or wins:
        return {"matches": [top], "ambiguous": False, "others": rest[:most]}
    return {"matches": rows[:most], "ambiguous": True, "hint": f"several places match {question!r}; name the state or the kind"}
