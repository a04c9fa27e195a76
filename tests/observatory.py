"""An observatory's policy, made up for these tests, and who may do what by plain Python."""

USERS = {
    "mira": {"role": "observer", "dome": "north", "fields": {"nebulae", "clusters"}, "crews": {"dawn", "dusk"}},
    "tomo": {"role": "observer", "dome": "south", "fields": {"planets"}, "crews": {"dusk"}},
    "vela": {"role": "engineer", "dome": "north"},
    "orin": {"role": "engineer", "dome": "south", "crews": {"dawn"}},
    "lyra": {"role": "guest", "hostOf": {"tomo"}},
}
THINGS = {
    "plate1": {"kind": "plate", "owner": "mira", "dome": "north", "subjects": {"nebulae"}, "crew": "dawn"},
    "plate2": {"kind": "plate", "owner": "tomo", "dome": "south", "subjects": {"planets"}, "crew": "dusk"},
    "plate3": {"kind": "plate", "owner": "mira", "dome": "south", "subjects": {"nebulae", "planets"}, "crew": "dusk"},
    "lens1": {"kind": "instrument", "owner": "vela", "dome": "north", "subjects": {"optics"}, "crew": "dusk"},
    "lens2": {"kind": "instrument", "owner": "orin", "dome": "south", "subjects": {"optics"}, "crew": "dawn"},
}
ACTIONS = ("adjust", "annotate", "view")
RULES = """
rule(role [ {engineer}; kind [ {instrument}; {adjust}; dome=dome)  # at home
rule(; kind [ {instrument}; {adjust}; crews ] crew)
rule(; kind [ {plate}; {view}; uid=owner)
rule(; kind [ {plate}; {view annotate}; fields > subjects, crews ] crew)
rule(; kind [ {plate}; {annotate}; hostOf ] owner)
"""


def text() -> str:
    said = lambda v: "{" + " ".join(sorted(v)) + "}" if isinstance(v, set) else v
    lines = [f"{kind}Attrib({name}, {', '.join(f'{k}={said(v)}' for k, v in own.items())})" for kind, rows in (("user", USERS), ("resource", THINGS)) for name, own in rows.items()]
    return "\n".join(["# people and things", *lines]) + RULES


def permitting(user: str, thing: str, action: str) -> list[str]:
    """The rules that permit it."""
    u, t = USERS[user], THINGS[thing]
    plate, crew = t["kind"] == "plate", t["crew"] in u.get("crews", set())
    holds = {
        "R1": action == "adjust" and u["role"] == "engineer" and not plate and u.get("dome") == t["dome"],
        "R2": action == "adjust" and not plate and crew,
        "R3": action == "view" and plate and user == t["owner"],
        "R4": action in ("view", "annotate") and plate and u.get("fields", set()) >= t["subjects"] and crew,
        "R5": action == "annotate" and plate and t["owner"] in u.get("hostOf", set()),
    }
    return [r for r, true in holds.items() if true]
