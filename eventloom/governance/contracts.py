"""Compatibility of schemas, lineage, and gates; small metadata, plain Python."""

from __future__ import annotations

from pyspark.sql import types as T


def breaking(
    old: T.StructType, new: T.StructType, required_old: set[str] = frozenset(), required_new: set[str] = frozenset(), open_old: bool = True, open_new: bool = True
) -> list[str]:
    """Why data of ``old`` can't be read by ``new``: a field removed, optional or not, a type changed, a field
    that begins or ceases to be required, or a schema closed to extra fields (``open_new``)."""
    before, after = {f.name: f.dataType for f in old}, {f.name: f.dataType for f in new}
    out = [f"{n}: type changed" for n in before.keys() & after.keys() if before[n] != after[n]]
    out += [f"{n}: removed" for n in before.keys() - after.keys()]
    out += [f"{n}: newly required" for n in required_new - required_old]
    out += [f"{n}: no longer required" for n in required_old - required_new]
    if open_old and not open_new:
        out.append("closed to extra fields")
    return sorted(out)


def compatible(
    old: T.StructType, new: T.StructType, mode: str, required_old: set[str] = frozenset(), required_new: set[str] = frozenset(), open_old: bool = True, open_new: bool = True
) -> bool:
    """BACKWARD: new reads old. FORWARD: old reads new. FULL: both."""
    back = not breaking(old, new, required_old, required_new, open_old, open_new)
    forth = not breaking(new, old, required_new, required_old, open_new, open_old)
    return {"BACKWARD": back, "FORWARD": forth, "FULL": back and forth}[mode]


def cycle(edges: list[tuple[str, str]]) -> list[str] | None:
    """A cycle in a lineage graph, or None."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    done: set[str] = set()
    for root in list(after):
        path, stack = [], [(root, iter(after.get(root, ())))]
        on: set[str] = {root}
        path.append(root)
        while stack:
            node, nxt = stack[-1]
            step = next(nxt, None)
            if step is None:
                stack.pop()
                on.discard(path.pop())
                done.add(node)
            elif step in on:
                return path[path.index(step) :] + [step]
            elif step not in done:
                stack.append((step, iter(after.get(step, ()))))
                path.append(step)
                on.add(step)
    return None


def gate(current: float, baseline: float, failures: float = 0.0, baseline_failures: float = 0.0, ratio: float = 0.8) -> bool:
    """Whether a throughput may pass: not below ``ratio`` of the baseline, failures no worse."""
    return current >= ratio * baseline and failures <= baseline_failures


def lag_total(ends: dict[str, int], committed: dict[str, int]) -> int:
    """Records not yet consumed over all partitions; one never committed counts from 0, one ahead of its end as 0."""
    return sum(max(end - committed.get(p, 0), 0) for p, end in ends.items())
