"""Stages as a checked graph: artifacts read and written, edges by outcome, simulated before anything runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions import fixed


@dataclass(frozen=True)
class Stage:
    """Reads and writes artifacts by name; goes on by outcome, None ends the run."""

    name: str
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    next: dict[str, str | None] = field(default_factory=lambda: {"ok": None})
    perform: Callable[[dict], str] = lambda state: "ok"


def simulate(stages: list[Stage], given: set[str] = frozenset()) -> list[str]:
    """What is wrong with a graph of stages in order: unknown or backward targets, stages no edge reaches, artifacts that may be missing.

    An artifact is available where every way in has it; only an `ok` edge adds
    what its stage writes.
    """
    names, faults = {s.name: k for k, s in enumerate(stages)}, []
    if len(names) < len(stages):
        faults.append("two stages share a name")
    inbound: dict[str, list[set[str]]] = {s.name: [] for s in stages}
    for k, s in enumerate(stages):
        ways = inbound[s.name] if k else [set(given)]
        if not ways:
            faults.append(f"{s.name}: no edge leads here")
            have: set[str] = set(given)
        else:
            have = set.intersection(*ways)
        faults += [f"{s.name}: may lack {r}" for r in s.reads if r not in have]
        for outcome, target in s.next.items():
            if target is None:
                continue
            if target not in names:
                faults.append(f"{s.name}: {outcome} leads to {target}, which doesn't exist")
            elif names[target] <= k:
                faults.append(f"{s.name}: {outcome} leads back to {target}")
            else:
                inbound[target].append(have | (set(s.writes) if outcome == "ok" else set()))
    return faults


def run(stages: list[Stage], state: dict) -> list[tuple[str, str]]:
    """Runs from the first stage on, along the edges; (stage, outcome) of each.  A graph with faults doesn't start."""
    if faults := simulate(stages, set(state)):
        raise ValueError("; ".join(faults))
    table, at, done = {s.name: s for s in stages}, stages[0].name, []
    while at is not None:
        stage = table[at]
        if lacking := [r for r in stage.reads if r not in state]:
            done.append((at, f"missing {', '.join(lacking)}"))
            break
        outcome = stage.perform(state)
        if outcome == "ok" and (bad := [w for w in stage.writes if w not in state]):
            done.append((at, f"didn't write {', '.join(bad)}"))
            break
        done.append((at, outcome))
        at = stage.next.get(outcome)
    return done


#: Old names of stages.
ALIASES = {
    "lang-select": ["lang-hint", "lang-decide"], "warmup": ["detect-changes"], "prep": ["collect-graph", "verify-graph", "derive-facts"], "survey-plan": ["schedule-batches"], "survey": ["annotate-symbols"], "warmup-save": ["snapshot-sources"],
    "terms": ["verify-terms"], "wiki": ["outline-wiki", "write-wiki"], "wiki-catalogue": ["outline-wiki"], "wiki-pages": ["write-wiki"], "build": ["publish-wiki"], "check": ["verify-wiki"],
}


def expand(names) -> list[str]:
    """Old names as the stages they stand for, in order."""
    return [s for n in names for s in ALIASES.get(n, [n])]


def chosen(order, only=None, skip=None, without=()) -> list[str]:
    """The stages of order that are among only (all where it is empty) and neither in skip nor in without; unknown names are an error."""
    wanted, left_out = set(only or []), set(skip or []) | set(without)
    if unknown := sorted((wanted | left_out) - set(order)):
        raise ValueError(f"no such stage: {', '.join(unknown)}")
    return [s for s in order if (not wanted or s in wanted) and s not in left_out]


def reading_stages(only=None, skip=None, cold: bool = False) -> list[str]:
    """Stages of a reading run, old names understood; a cold one compares with nothing."""
    return chosen(fixed.STAGE_ORDER, expand(only or []), expand(skip or []), fixed.WARM_ONLY if cold else ())


def grading_stages(has_candidates: bool, has_answers: bool, only=None, skip=None, ask: bool = False) -> list[str]:
    """Stages of a quiz run: without answers it ends before grading, or asks for them first."""
    if only:
        return chosen(fixed.GRADE_STAGES, only)
    out: list[str] = []
    for s in chosen(fixed.GRADE_STAGES, None, skip, ("collect",) if has_candidates else ()):
        if s != "collect" and not has_answers:
            if not ask:
                continue
            out += ["ask"] if s == "grade" else []
        out.append(s)
    return out


def report_stages(has_manuscript: bool, only=None, skip=None) -> list[str]:
    """Stages of a report run: what is written isn't written again."""
    return chosen(fixed.REPORT_STAGES, only, skip, () if only or not has_manuscript else ("agent",))


def restart_from(failed_at: str | None) -> str | None:
    """The stage a failed run starts again at."""
    return fixed.RESTART_AT.get(failed_at, failed_at)


def destination(edges: dict[tuple[str, str], str | None], stage: str, outcome: str) -> str | None:
    """Where an outcome of a stage leads: its own edge, or that of any stage."""
    return edges[stage, outcome] if (stage, outcome) in edges else edges.get(("*", outcome))
