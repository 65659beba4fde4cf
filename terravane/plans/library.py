"""Named methods (M8): fixed questions with parameters, written as templates of tool calls.

A template's values may be ``$name``: the parameter, or what follows from it (``derived``). A condition or a filter whose
parameter wasn't given is left out; a call under ``if`` or ``unless`` runs only with or without that parameter. Later
calls may take what an earlier one found: ``$found`` is the first match of a search.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .compiler import QueryError

#: Measures of access: the field to rank by, the way that puts the worst first, and what is told beside it (fixed values).
MEASURES = {
    "short": ("pct_lt20_trials_within_60rdmi", "desc", "people_lt20_trials_within_60rdmi"),
    "none": ("pct_zero_trials_within_60rdmi", "desc", "people_zero_trials_within_60rdmi"),
    "far_nci": ("pct_gt60rdmi_nci", "desc", "median_road_mi_nci"),
    "median_nci": ("median_road_mi_nci", "desc", "nearest_nci"),
    "far_broad": ("pct_gt60rdmi_broad_menu", "desc", "median_road_mi_broad_menu"),
    "trials_near": ("wmean_trials_within_60rdmi", "asc", "pct_lt20_trials_within_60rdmi"),
}
_PCT, _PEOPLE = MEASURES["short"][0], MEASURES["short"][2]
_NONE, _NOBODY = MEASURES["none"][0], MEASURES["none"][2]


@dataclass(frozen=True)
class Method:
    """A named question: its parameters, those of them that it needs, and its calls."""

    title: str
    needs: tuple[str, ...]
    takes: tuple[str, ...]
    calls: tuple[dict, ...]


def _ask(table: str, *columns: str, where=(), by=None, way: str = "desc", limit=None, **when) -> dict:
    spec = {"table": table, "where": [dict(zip(("field", "op", "value"), w)) for w in where], "columns": list(columns)}
    if by:
        spec["order_by"] = [{"field": by, "dir": way}]
    if limit:
        spec["limit"] = limit
    return {"tool": "query", "spec": spec, **when}


def _tool(tool: str, spec: dict, **when) -> dict:
    return {"tool": tool, "spec": spec, **when}


_IN_STATE, _THE_STATE = ("state", "=", "$state"), ("id", "=", "$state")
_SPLIT = ("nonmetro_pct", *(f"{side}.{f}" for f in ("pop55", "pct_lt20", "pct_zero", "median_road_mi_nci") for side in ("metro", "nonmetro")))
_HEADLINE = (_PCT, _PEOPLE, _NONE, "pct_gt60rdmi_nci", "pct_gt60rdmi_broad_menu", "median_road_mi_nci", "wmean_trials_within_60rdmi", "nonmetro_pct")
_MEMBER = ("member.name", "member.party", "member.ctma_hr3521")
_ONC_SHARE = "oncologists.pct_pop55_in_counties_with_oncologists_no_trials"
_STATE_OR_NATION = lambda *columns: (_ask("states", *columns, where=[_THE_STATE], **{"if": "state"}), _ask("national", *columns, **{"unless": "state"}))


def _need(kind: str, rate: str, low: str, per_year: str, group: str) -> tuple[dict, ...]:
    flags = _ask("counties", f"{rate}.all", _PCT, where=[_IN_STATE, (low, "=", True)], by="pop55", limit=20)
    return flags, _ask("states", f"{kind}.counties_classified", f"{kind}.{group}", f"{kind}.pop55", f"{kind}.{per_year}", where=[_THE_STATE])


METHODS: dict[str, Method] = {
    **{
        f"{table}_{end}_access": Method(f"{table} with the {end} access", (), ("measure", "n") if table == "states" else ("state", "measure", "n"), (_ask(table, "$measure_field", "$measure_more", where=[] if table == "states" else [_IN_STATE], by="$measure_field", way=f"$measure_{end}", limit="$n"),))
        for table in ("counties", "districts", "states")
        for end in ("worst", "best")
    },
    "counties_short_of_trials": Method("Counties where most people are short of trials", (), ("state",), (_ask("counties", _PCT, _PEOPLE, where=[_IN_STATE, (_PCT, ">=", 50)], by="pop55", limit=20), *_STATE_OR_NATION(_PCT, _PEOPLE))),
    "people_short_of_trials_state": Method("People short of trials in a state", ("state",), (), (_ask("states", _PCT, _PEOPLE, _NONE, _NOBODY, where=[_THE_STATE]), _ask("national", _PCT, _PEOPLE, _NONE, _NOBODY))),
    "counties_no_trial_within_60": Method("Counties with no trial within 60 miles", (), ("state",), (_ask("counties", "trials_within_60rdmi_of_center", _NONE, where=[_IN_STATE, ("trials_within_60rdmi_of_center", "=", 0)], by="pop55", limit=20), *_STATE_OR_NATION(_NONE, _NOBODY))),
    "oncologists_no_trials_counties": Method("Counties with oncologists and no trials", ("state",), (), (_ask("counties", "oncologists.count", "trials_listed_here", _PCT, where=[_IN_STATE, ("oncologists.class", "=", 2)], by="pop55", limit=25),)),
    "oncologists_no_trials_districts": Method("Districts with oncologists and no trials", ("state",), (), (_ask("districts", _ONC_SHARE, "oncologists.counties_with_oncologists_no_trials", "member.name", where=[_IN_STATE, (_ONC_SHARE, ">", 0)], by=_ONC_SHARE, limit=25),)),
    "need_vs_access_state": Method("High incidence and low access", ("state",), (), _need("need_vs_access", "incidence", "high_incidence_low_access", "cases_per_year", "high_incidence_low_access_counties")),
    "deaths_vs_access_state": Method("High death rates and low access", ("state",), (), _need("deaths_vs_access", "mortality", "high_deaths_low_access", "deaths_per_year", "high_death_low_access_counties")),
    "hr3521_cosponsors_state": Method("A state's cosponsors in the House", ("state",), (), (_ask("cosponsors", "party", "district_id", "role", "date", where=[("bill", "=", "ctma_hr"), _IN_STATE], by="date", way="asc", limit=50), _ask("districts", *_MEMBER, where=[_IN_STATE], by="id", way="asc", limit=50))),
    "hr3521_cosponsors_all": Method("All cosponsors in the House", (), (), (_ask("cosponsors", "party", "district_id", "role", "date", where=[("bill", "=", "ctma_hr")], by="date", way="asc", limit=50), _tool("aggregate", {"table": "cosponsors", "where": [{"field": "bill", "op": "=", "value": "ctma_hr"}], "group_by": "party", "measures": [{"field": "id", "stat": "count"}]}))),
    "s4440_senators": Method("Senators on the bill", (), ("state",), (_ask("senators", "party", "s4440", "cosponsor_date", where=[_IN_STATE], **{"if": "state"}), _ask("senators", "party", "s4440", "cosponsor_date", where=[("s4440", "!=", "none")], by="cosponsor_date", way="asc", limit=50, **{"unless": "state"}))),
    "my_representative": Method("Who represents a place", ("query",), (), (_tool("find_places", {"query": "$query", "limit": 5}), _tool("profile", {"table": "$found_table", "id": "$found"}, **{"if": "found_local"}), _ask("districts", *_MEMBER, where=[("state", "=", "$found")], by="id", way="asc", limit=50, **{"if": "found_state"}))),
    "place_profile": Method("All about a place", ("place",), (), (_tool("profile", {"table": "$place_table", "id": "$place"}),)),
    "state_vs_nation": Method("A state beside the nation", ("state",), (), (_ask("states", *_HEADLINE, where=[_THE_STATE]), _ask("national", *_HEADLINE))),
    "rural_vs_metro_state": Method("Rural and metro access in a state", ("state",), (), (_ask("states", *_SPLIT, where=[_THE_STATE]), _ask("national", *_SPLIT))),
    "rural_vs_metro_nation": Method("Rural and metro access in the nation", (), (), (_ask("national", *_SPLIT),)),
    "nci_centers_state": Method("Centers in a state", ("state",), (), (_ask("nci_centers", "full_name", "tier", where=[_IN_STATE], by="name", way="asc", limit=50), _ask("states", "median_road_mi_nci", "pct_gt60rdmi_nci", "nearest_nci", where=[_THE_STATE]))),
    "nearest_nci_county": Method("The center nearest to a county", ("county",), (), (_ask("counties", "nearest_nci", "road_mi_nci_from_center", "drive_hours_nci", "median_road_mi_nci", "pct_gt60rdmi_nci", where=[("id", "=", "$county")]),)),
    "counties_far_from_nci_state": Method("Counties over 100 miles from a center", (), ("state", "n"), (_ask("counties", "road_mi_nci_from_center", "nearest_nci", "drive_hours_nci", where=[_IN_STATE, ("road_mi_nci_from_center", ">", 100)], by="road_mi_nci_from_center", limit="$n20"),)),
    "trials_in_county": Method("Trials in a county", ("county",), ("cancer_type",), (_tool("trials", {"scope": {"area": "$county"}, "label": "$cancer_type", "limit": 10}),)),
    "trials_near_county": Method("Trials within 60 miles of a county", ("county",), ("phase", "cancer_type"), (_tool("trials", {"scope": {"near_area": "$county"}, "phase": "$phase", "label": "$cancer_type", "limit": 10}),)),
    "trials_in_state": Method("Trials in a state", ("state",), ("cancer_type", "phase"), (_tool("trials", {"scope": {"state": "$state"}, "label": "$cancer_type", "phase": "$phase", "limit": 10}), _ask("states", "trials_distinct", "counties", "counties_with_trials", where=[_THE_STATE]))),
    "district_counties": Method("Counties of a district", ("district",), (), (_ask("counties", _PCT, "trials_listed_here", "oncologists.count", where=[("districts", "includes", "$district")], by="pop55", limit=50), _ask("districts", _PCT, "trials_listed_here", *_MEMBER, where=[("id", "=", "$district")]))),
    "trial_type_access_state": Method("Access to one type's trials in a state", ("state", "cancer_type"), ("n",), (_ask("counties", "$type_none", where=[_IN_STATE], by="$type_none", limit="$n"), _ask("states", "$type_near", where=[_THE_STATE]))),
    "incidence_rank_counties": Method("Counties of highest incidence", (), ("state", "site", "n"), (_ask("counties", "$incidence", "incidence.small_numbers", _PCT, where=[_IN_STATE, ("$incidence", "not_null")], by="$incidence", limit="$n"),)),
    "death_rate_rank_counties": Method("Counties of highest death rates", (), ("state", "site", "n"), (_ask("counties", "$mortality", "mortality.small_numbers", _PCT, where=[_IN_STATE, ("$mortality", "not_null")], by="$mortality", limit="$n"),)),
    "oncologists_per_capita_states": Method("Oncologists for so many people, by state", (), ("n",), (_ask("states", "oncologists.oncologists_per_100k_pop55", "oncologists.count", by="oncologists.oncologists_per_100k_pop55", limit="$n"),)),
}


def _district(text: str) -> str:
    m = re.fullmatch(r"([A-Z]{2})[-\s]*(\d{1,2}|AL)", text.strip().upper())
    if not m:
        raise QueryError(f"{text!r} is no district", "a state and a number, as TX-34")
    return f"{m[1]}-{'00' if m[2] == 'AL' else m[2].zfill(2)}"


def place_table(text: str) -> str:
    """The table of a place's id."""
    for pattern, table in ((r"\d{4,5}", "counties"), (r"[A-Za-z]{2}-(?:\d{1,2}|AL)", "districts"), (r"(?i)us", "national"), (r"[A-Za-z]{2}", "states")):
        if re.fullmatch(pattern, text.strip()):
            return table
    raise QueryError(f"{text!r} is no place's id", "a county's number, a district as TX-34, a state's code or US")


def checked(method: Method, name: str, given: dict, states: dict[str, str], choices: dict[str, list[str]]) -> dict:
    """Parameters in the form that the tables use; unknown, missing and bad ones raise QueryError."""
    known = (*method.needs, *method.takes)
    for k in given:
        if k not in known:
            raise QueryError(f"{name} takes no {k}", list(known))
    out: dict = {}
    for k in known:
        v = given.get(k)
        if v is None or v == "":
            continue
        text = str(v).strip()
        if k == "state":
            v = states.get(text.lower())
            if v is None:
                raise QueryError(f"no state {text!r}", "a state's name or code")
        elif k == "district":
            v = _district(text)
        elif k == "county":
            if not re.fullmatch(r"\d{4,5}", text):
                raise QueryError(f"{text!r} is no county's id", "five digits")
            v = text.zfill(5)
        elif k == "place":
            v = text.zfill(5) if place_table(text) == "counties" else _district(text) if place_table(text) == "districts" else text.upper()
        elif k == "n":
            if not re.fullmatch(r"\d+", text) or not 1 <= int(text) <= 50:
                raise QueryError("n is a whole number from 1 to 50")
            v = int(text)
        else:
            v = text
            allowed = list(MEASURES) if k == "measure" else choices.get(k)
            if allowed and v not in allowed:
                raise QueryError(f"no {k} {text!r}", allowed)
        out[k] = v
    for k in method.needs:
        if k not in out:
            raise QueryError(f"{name} needs {k}")
    return out


def derived(p: dict) -> dict:
    """Parameters and what follows from them."""
    field, worst, more = MEASURES[p.get("measure", "short")]
    out = dict(p) | {"measure_field": field, "measure_more": more, "measure_worst": worst, "measure_best": "asc" if worst == "desc" else "desc"}
    out |= {"n": p.get("n", 10), "n20": p.get("n", 20)}
    for rate in ("incidence", "mortality"):
        out[rate] = f"{rate}.all" if p.get("site", "all") == "all" else f"{rate}.by_site.{p['site']}"
    if "cancer_type" in p:
        out |= {"type_none": f"zero_trial_share_by_type.{p['cancer_type']}", "type_near": f"trials_within_60rdmi_by_cancer_type.{p['cancer_type']}"}
    if "place" in p:
        out["place_table"] = place_table(p["place"])
    return out


def found(p: dict, results: list[dict]) -> dict:
    """What the first search found, as parameters of later calls."""
    first = next((r["matches"][0] for r in results if r.get("matches")), None)
    if not first:
        return p
    out = p | {"found": first["id"], "found_table": first["table"]}
    return out | ({"found_state": True} if first["table"] == "states" else {"found_local": True})


_GONE = object()


def filled(template, p: dict):
    """A template with its parameters; what has a parameter that wasn't given is left out."""
    if isinstance(template, str) and template.startswith("$"):
        return p.get(template[1:], _GONE)
    if isinstance(template, list):
        return [x for x in (filled(t, p) for t in template) if x is not _GONE]
    if isinstance(template, dict):
        out = {k: filled(v, p) for k, v in template.items()}
        if "field" in out and _GONE in out.values():
            return _GONE
        return {k: v for k, v in out.items() if v is not _GONE}
    return template


def run(method: Method, p: dict, call: Callable[[str, dict], dict]) -> list[dict]:
    """The answers of a method's calls, in order."""
    results: list[dict] = []
    p = derived(p)
    for c in method.calls:
        p = found(p, results)
        if ("if" in c and c["if"] not in p) or ("unless" in c and c["unless"] in p):
            continue
        results.append(call(c["tool"], filled(c["spec"], p)))
    return results
