"""Lifecycles over branching code: states follow every path, and facts of different branches never combine.

One group is one function's facts, so groups are as small as functions are; the state
of a path is immutable, equal states merge, and beyond ``most`` alternatives the rest
is dropped and the group marked incomplete, which makes its findings possible only.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: action: source, match:<k>, write:<k>, sink, kill; control: if, else, endif, loop, endloop, break, continue, return, try, catch, endtry
RESULT = "path string, function_id long, fact_id long, object long, certainty string, paths long, matched long"


@dataclass(frozen=True)
class State:
    source: int | None = None
    met: frozenset[int] = frozenset()


def _apply(state: State, fact: int, action: str, need: int, mode: str, hits: dict, done: bool = True) -> State:
    name, _, k = action.partition(":")
    if name == "source":
        return State(fact)
    if state.source is None:
        return state
    if name == "kill":
        return State()
    if name == "write":
        return State(state.source, state.met - {int(k)})
    if name == "match":
        return State(state.source, state.met | {int(k)})
    if name == "sink":
        ready = len(state.met) == need if mode == "all" else bool(state.met)
        hits.setdefault(fact, []).append(ready)
    return state


def run_object(rows: list[tuple[int, str, str]], need: int, mode: str, most: int = 64, rounds: int = 16) -> tuple[dict[int, list[bool]], bool]:
    """For (fact_id, action, control) in order: readiness of every distinct path at each sink, and completeness."""
    hits: dict[int, list[bool]] = {}
    whole = True

    def bounded(states: set[State]) -> set[State]:
        nonlocal whole
        if len(states) > most:
            whole = False
            states = set(sorted(states, key=lambda s: (s.source or -1, sorted(s.met)))[:most])
        return states

    def block(i: int, states: set[State], ends: set[str], leave: dict[str, set[State]]) -> tuple[int, set[State]]:
        nonlocal whole
        while i < len(rows):
            fact, action, control = rows[i]
            if control in ends:
                return i, states
            if control == "if":
                i, then = block(i + 1, states, {"else", "endif"}, leave)
                other = states
                if i < len(rows) and rows[i][2] == "else":
                    i, other = block(i + 1, states, {"endif"}, leave)
                states = bounded(then | other)
            elif control == "try":
                i, tried = block(i + 1, states, {"catch", "endtry"}, leave)
                caught: set[State] = set()
                if i < len(rows) and rows[i][2] == "catch":
                    i, caught = block(i + 1, bounded(states | tried), {"endtry"}, leave)
                states = bounded(tried | caught)
            elif control == "loop":
                seen, now, start = set(states), set(states), i + 1
                inner: dict[str, set[State]] = {"break": set(), "continue": set(), "return": leave["return"]}
                for _ in range(rounds):
                    i, out = block(start, now, {"endloop"}, inner)
                    now = bounded(out | inner["continue"]) - seen
                    inner["continue"] = set()
                    seen = bounded(seen | now)
                    if not now:
                        break
                else:
                    whole = False
                states = bounded(seen | inner["break"])
            elif control in ("break", "continue", "return"):
                leave.setdefault(control, set()).update(states)
                states = set()
            elif action:
                states = {_apply(s, fact, action, need, mode, hits) for s in states}
            i += 1
        return i, states

    block(0, {State()}, set(), {"return": set()})
    return hits, whole


def branching(facts: DataFrame, need: int, mode: str = "any", most: int = 64) -> DataFrame:
    """Sinks reached with readiness on some path: definite if on all of them and nothing was cut.

    ``facts``: path, function_id, object, fact_id, action, control; control rows have a null object.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("fact_id", kind="stable")
        out = []
        for obj in sorted(frame["object"].dropna().unique()):
            own = frame[frame["object"].isna() | (frame["object"] == obj)]
            rows = [(int(f), a or "", c or "") for f, a, c in zip(own["fact_id"], own["action"], own["control"], strict=True)]
            hits, whole = run_object(rows, need, mode, most)
            for fact, ready in sorted(hits.items()):
                if any(ready):
                    certain = "definite" if all(ready) and whole else "possible"
                    out.append((frame["path"].iloc[0], int(frame["function_id"].iloc[0]), fact, int(obj), certain, len(ready), sum(ready)))
        return pd.DataFrame(out, columns=["path", "function_id", "fact_id", "object", "certainty", "paths", "matched"])

    return facts.groupBy("path", "function_id").applyInPandas(run, RESULT)
