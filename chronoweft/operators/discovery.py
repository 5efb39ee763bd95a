"""Model discovery: an inductive miner on counted sequences, and incremental discovery, which changes a tree
step by step until a new trace fits, and all earlier ones still do.

The log is reduced to its distinct sequences in the cluster; those come to the driver, where the (small)
models live, if they are at most ``most_variants``.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.operators.alignment import FRAGMENT_MODES, LOG, MODEL, SYNC, TAU, Aligner, runs_of_node, shortest_run
from chronoweft.operators.projection import sequences
from chronoweft.plans import process_tree as P

MOST_VARIANTS = 100_000
Log = Counter
"""Sequences (tuples of labels) and how many cases have each."""


def counted(log: DataFrame, most_variants: int = MOST_VARIANTS) -> Log:
    rows = sequences(log).groupBy("acts").agg(F.count("*").alias("n")).limit(most_variants + 1).collect()
    if len(rows) > most_variants:
        raise ValueError(f"more than {most_variants} distinct sequences")
    return Counter({tuple(r["acts"]): r["n"] for r in rows})


def directly_follows(log: DataFrame) -> DataFrame:
    """a, b, n over consecutive events; null for what comes before the first and after the last."""
    acts = sequences(log).select(F.concat(F.array(F.lit(None).cast("string")), "acts", F.array(F.lit(None).cast("string"))).alias("x"))
    steps = F.transform(F.sequence(F.lit(0), F.size("x") - 2), lambda i: F.struct(F.get("x", i).alias("a"), F.get("x", i + 1).alias("b")))
    return acts.select(F.explode(steps).alias("s")).groupBy("s.a", "s.b").agg(F.count("*").alias("n"))


# The inductive miner


def _graph(log: Log) -> tuple[dict[str, set[str]], set[str], set[str]]:
    after: dict[str, set[str]] = {a: set() for t in log for a in t}
    for t in log:
        for a, b in zip(t, t[1:], strict=False):
            after[a].add(b)
    return after, {t[0] for t in log if t}, {t[-1] for t in log if t}


def _parts(names: list[str], joined) -> list[set[str]]:
    """Connected parts of an undirected relation."""
    left, out = list(names), []
    while left:
        part, todo = set(), [left[0]]
        while todo:
            a = todo.pop()
            if a not in part:
                part.add(a)
                todo += [b for b in left if b not in part and joined(a, b)]
        left = [a for a in left if a not in part]
        out.append(part)
    return out


def _reach(after: dict[str, set[str]]) -> dict[str, set[str]]:
    out = {}
    for a in after:
        seen, todo = set(), list(after[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += after[b]
        out[a] = seen
    return out


def _sequence_cut(names: list[str], after: dict[str, set[str]]) -> list[set[str]] | None:
    reach = _reach(after)
    groups = _parts(names, lambda a, b: (b in reach[a]) == (a in reach[b]))
    merged = True
    while merged:  # parts that aren't ordered, or not fully, belong together
        merged = False
        for i, x in enumerate(groups):
            for y in groups[i + 1 :]:
                forth = all(b in reach[a] for a in x for b in y)
                back = all(a in reach[b] for a in x for b in y)
                if forth == back:
                    groups = [g for g in groups if g not in (x, y)] + [x | y]
                    merged = True
                    break
            if merged:
                break
    if len(groups) < 2:
        return None
    return sorted(groups, key=lambda g: sum(next(iter(g)) in reach[next(iter(h))] for h in groups if h is not g))


def _parallel_cut(names: list[str], after: dict[str, set[str]], first: set[str], last: set[str]) -> list[set[str]] | None:
    groups = _parts(names, lambda a, b: not (b in after[a] and a in after[b]))
    whole = [g for g in groups if g & first and g & last]
    rest = [g for g in groups if not (g & first and g & last)]
    if not whole:
        return None
    for g in rest:
        whole[0] = whole[0] | g
    return whole if len(whole) > 1 else None


def _loop_cut(names: list[str], after: dict[str, set[str]], first: set[str], last: set[str]) -> tuple[set[str], set[str]] | None:
    body = first | last
    others = [a for a in names if a not in body]
    groups = _parts(others, lambda a, b: b in after[a] or a in after[b])
    back = set()
    for g in groups:
        entered = {a for a in names if a not in g and after[a] & g}
        left = {b for a in g for b in after[a] if b not in g}
        complete = all(b in after[x] for b in {y for y in g if any(y in after[e] for e in last)} for x in last) and all(f in after[x] for x in {y for y in g if after[y] & first} for f in first)
        if entered <= last and left <= first and entered and left and complete:
            back |= g
        else:
            body |= g
    return (body, back) if back else None


def mine(log: Log) -> P.Tree:
    """A tree whose language has every sequence of the log."""
    return P.reduced(_mine(Counter({tuple(t): n for t, n in log.items()})))


def _mine(log: Log) -> P.Tree:
    names = sorted({a for t in log for a in t})
    if not names:
        return P.TAU
    if () in log:
        return P.op("xor", P.TAU, _mine(Counter({t: n for t, n in log.items() if t})))
    if len(names) == 1:
        one = P.act(names[0])
        return one if all(len(t) == 1 for t in log) else P.op("loop", one, P.TAU)
    after, first, last = _graph(log)
    groups = _parts(names, lambda a, b: b in after[a] or a in after[b])
    if len(groups) > 1:
        return P.op("xor", *(_mine(Counter({t: n for t, n in log.items() if t[0] in g})) for g in groups))
    if groups := _sequence_cut(names, after):
        return P.op("seq", *(_mine(x) for x in _split(log, groups)))
    if groups := _parallel_cut(names, after, first, last):
        return P.op("and", *(_mine(x) for x in _split(log, groups)))
    if cut := _loop_cut(names, after, first, last):
        body, back = cut
        parts: tuple[Log, Log] = (Counter(), Counter())
        for t, n in log.items():
            now, inside = [], 0
            for a in t:
                side = int(a in back)
                if side != inside:
                    parts[inside][tuple(now)] += n
                    now, inside = [], side
                now.append(a)
            parts[inside][tuple(now)] += n
            if inside:
                parts[0][()] += n
        return P.op("loop", _mine(parts[0]), _mine(parts[1]))
    for a in names:  # an activity that every sequence has once is parallel to the rest
        if all(t.count(a) == 1 for t in log):
            rest: Log = Counter()
            for t, n in log.items():
                rest[tuple(x for x in t if x != a)] += n
            return P.op("and", P.act(a), _mine(rest))
    return P.op("loop", P.op("xor", *map(P.act, names)), P.TAU)


def _split(log: Log, groups: list[set[str]]) -> list[Log]:
    out: list[Log] = [Counter() for _ in groups]
    for t, n in log.items():
        for g, x in zip(groups, out, strict=True):
            x[tuple(a for a in t if a in g)] += n
    return out


def discover(log: DataFrame, most_variants: int = MOST_VARIANTS) -> P.Tree:
    return mine(counted(log, most_variants))


# Incremental discovery


def _aligned(aligner: Aligner, trace: tuple[str, ...]):
    found = aligner.align(trace)
    if found is None:
        raise ValueError("the alignment of a trace was given up; allow more states")
    return found


def _all_fit(tree: P.Tree, traces: list[tuple[str, ...]]) -> bool:
    aligner = Aligner(tree)
    return all(_aligned(aligner, t).fits for t in traces)


def add_trace(tree: P.Tree, added: list[tuple[str, ...]], trace: tuple[str, ...], pull_down: bool = False, borders: bool = True) -> P.Tree:
    """A tree in whose language are the trace and all those added before.

    While the trace deviates: the lowest node that holds the synchronous moves on both sides of the first
    deviation is discovered anew, from what the earlier traces do in it and from the trace's own part. A
    node that can't be changed to any effect gives way to its parent; the root holds everything, and
    what is mined from all traces fits them all, so this ends. ``borders`` puts artificial activities around
    the tree and all traces meanwhile: then no deviation is without moves on both sides. With ``pull_down``, of a
    sequence or parallel only the children that the two moves span are discovered anew."""
    tree = P.reduced(tree)
    if borders:
        around = lambda t: (START, *t, END)
        tree, added, trace = P.with_borders(tree), [around(t) for t in added], around(trace)
    while not (own := _aligned(Aligner(tree), trace)).fits:
        tree = _solved(tree, added, trace, own, pull_down)
    return P.without_borders(tree) if borders else tree


START, END = "▶", "■"


def _solved(tree: P.Tree, added: list[tuple[str, ...]], trace: tuple[str, ...], own, pull_down: bool) -> P.Tree:
    """The tree after the first deviation is dealt with: the trace costs less, and all others fit."""
    number = around_deviation(tree, own)
    if pull_down and number >= 0:
        grouped, lower = _pulled_down(tree, number, _enclosing(own))
        if lower != number:
            tree, number, own = grouped, lower, _aligned(Aligner(grouped), trace)
            if _enclosing_node(tree, own) != number:  # another alignment of the same cost: then at the node above
                number = P.parents(tree)[number]
    while number > 0:
        part = _part_of(tree, own, trace, number)
        new = P.reduced(P.replaced(tree, number, mine(_sub_log(tree, added, number) + Counter([part]))))
        if _aligned(Aligner(new), trace).cost < own.cost and _all_fit(new, added):
            return new
        number = P.parents(tree)[number]
    return mine(Counter([*added, trace]))


def _enclosing(own) -> tuple[int | None, int | None]:
    """The leaves of the synchronous moves before and after the first deviation."""
    at = own.first_deviation()
    left = next((m.node for m in reversed(own.moves[:at]) if m.kind == SYNC), None)
    right = next((m.node for m in own.moves[at:] if m.kind == SYNC), None)
    return left, right


def around_deviation(tree: P.Tree, own) -> int:
    """The node that is discovered anew for the first deviation: the lowest operator above both moves around it."""
    at = own.first_deviation()
    left, right = _enclosing(own)
    here = own.moves[at].node if own.moves[at].kind == MODEL else None
    known = [n for n in (left, right, here) if n is not None]
    if left is None or right is None:
        return 0
    number = P.common_ancestor(tree, known)
    return number if P.children(P.nodes(tree)[number]) else max(P.parents(tree)[number], 0)


def _enclosing_node(tree: P.Tree, own) -> int:
    left, right = _enclosing(own)
    return P.common_ancestor(tree, [left, right]) if left is not None and right is not None else 0


def _pulled_down(tree: P.Tree, number: int, leaves: tuple[int | None, int | None]) -> tuple[P.Tree, int]:
    """The tree with those children of a sequence or parallel that lie from one leaf's to the other's in a node of
    their own, and its number. The language is the same."""
    kind, parts = P.nodes(tree)[number]
    if None in leaves or kind not in ("seq", "and"):
        return tree, number
    starts = [number + 1 + sum(map(P.size, parts[:k])) for k in range(len(parts))]
    own = sorted(max(k for k in range(len(parts)) if starts[k] <= leaf) for leaf in leaves if leaf > number)
    if len(own) < 2 or own[0] == own[1]:
        return tree, number
    chosen = range(own[0], own[1] + 1) if kind == "seq" else own
    if len(chosen) == len(parts):
        return tree, number
    inner = (kind, tuple(parts[k] for k in chosen))
    rest = [k for k in range(len(parts)) if k not in chosen]
    made = [*(parts[k] for k in rest if k < own[0]), inner, *(parts[k] for k in rest if k > own[0])]
    lower = number + 1 + sum(P.size(parts[k]) for k in rest if k < own[0])
    return P.replaced(tree, number, (kind, tuple(made))), lower


def _sub_log(tree: P.Tree, added: list[tuple[str, ...]], number: int) -> Log:
    aligner = Aligner(tree)
    return Counter(r for t in added for r in runs_of_node(_aligned(aligner, t), tree, number))


def _part_of(tree: P.Tree, own, trace: tuple[str, ...], number: int) -> tuple[str, ...]:
    """The trace's own part in a node: from its first to its last synchronous move there, with what the log
    alone does between; all of it at the root."""
    if number == 0:
        return trace
    inside = range(number, number + P.size(P.nodes(tree)[number]))
    at = own.first_deviation()
    places = [i for i, m in enumerate(own.moves) if m.node in inside and m.kind == SYNC]
    before = [i for i, m in enumerate(own.moves[:at]) if m.node == number and m.phase == "active"]
    start = before[-1] if before else min([*places, at])
    closing = [i for i, m in enumerate(own.moves) if i > at and m.node == number and m.phase == "closed"]
    stop = closing[0] if closing else max([*places, at])
    return tuple(m.activity for m in own.moves[start : stop + 1] if m.kind == LOG or m.kind == SYNC and m.node in inside)


Typed = tuple[str, tuple[str, ...]]
"""A tag of FRAGMENT_MODES, and a trace or a fragment of one."""


def _whole(tree: P.Tree, typed: Typed) -> tuple[str, ...]:
    """A whole trace with a fragment where its tag says it stands, with as few deviations from the tree as it can:
    the fragment itself, between shortest runs to where its alignment begins and from where it ends."""
    tag, fragment = typed
    if tag == "NOT_AN_INFIX":
        return fragment
    aligner = Aligner(tree, FRAGMENT_MODES[tag])
    found = _aligned(aligner, fragment)
    before = shortest_run(aligner.net, aligner.net.initial, found.start) if tag != "PREFIX" else ()
    after = shortest_run(aligner.net, found.end, aligner.net.final) if tag != "POSTFIX" else ()
    return (*before, *fragment, *after)


def add_typed(tree: P.Tree, added: list[Typed], new: Typed, pull_down: bool = False) -> P.Tree:
    """As :func:`add_trace` for traces of which only a prefix, an infix or a suffix was seen: each is completed to
    a whole trace of the tree, the new one to one that deviates where the fragment does, and these are kept."""
    return add_trace(tree, [_whole(tree, x) for x in added], _whole(tree, new), pull_down)


def repair_naively(tree: P.Tree, trace: tuple[str, ...]) -> P.Tree:
    """The tree after making each model move optional, and each log move possible after the node before it."""
    own = _aligned(Aligner(tree), trace)
    optional = {m.node for m in own.moves if m.kind == MODEL}
    inserted: dict[int, list[str]] = defaultdict(list)
    last = None
    lead: list[str] = []
    for m in own.moves:
        if m.kind in (SYNC, MODEL):
            last = m.node
        elif m.kind == LOG:
            (inserted[last] if last is not None else lead).append(m.activity)
    count = -1

    def run(t: P.Tree) -> P.Tree:
        nonlocal count
        count += 1
        me = count
        if P.children(t):
            return (t[0], tuple(run(c) for c in t[1]))
        new = P.op("xor", t, P.TAU) if me in optional else t
        if me in inserted:
            new = P.op("seq", new, *(P.op("xor", P.act(a), P.TAU) for a in inserted[me]))
        return new

    made = run(tree)
    if lead:
        made = P.op("seq", *(P.op("xor", P.act(a), P.TAU) for a in lead), made)
    return P.reduced(made)


def rebuild(log: DataFrame, most_variants: int = MOST_VARIANTS, pull_down: bool = False) -> P.Tree:
    """Incremental discovery over a log's sequences, the most frequent first."""
    order = sorted(counted(log, most_variants).items(), key=lambda x: (-x[1], x[0]))
    if not order:
        return P.TAU
    tree, added = mine(Counter([order[0][0]])), [order[0][0]]
    for trace, _ in order[1:]:
        tree = add_trace(tree, added, trace, pull_down)
        added.append(trace)
    return tree


# Freezing


def by_cardinality(part: P.Tree, runs: Counter | list[int]) -> P.Tree:
    """A part that runs once, at most once, or any number of times, as its numbers of runs ask."""
    least, most = min(runs, default=0), max(runs, default=0)
    repeated = P.op("loop", part, P.TAU) if most > 1 else part
    return P.op("xor", P.TAU, repeated) if least == 0 else repeated


def _marks(number: int) -> tuple[str, str, str]:
    """Labels that stand for the begin and the end of a frozen part's runs, and for the part itself."""
    return f"⟨{number}+⟩", f"⟨{number}-⟩", f"⟨{number}⟩"


def add_trace_frozen(tree: P.Tree, added: list[tuple[str, ...]], trace: tuple[str, ...], frozen: list[int], pull_down: bool = False) -> P.Tree:
    """As :func:`add_trace`, with the subtrees at the numbers ``frozen`` (none inside another) left as they are:
    each stands in the result once.

    A frozen part becomes a begin and an end, in the tree and in the traces; what a trace does between them
    without the part stays between them. After discovery, where just the end follows the begin, the part takes
    their place. Elsewhere the lowest node above all its begins and ends goes on without them, in parallel to the
    part, which may run there as often as it did."""
    parts = [P.nodes(tree)[n] for n in frozen]
    plain = tree
    for n in sorted(frozen, reverse=True):
        begin, end, _ = _marks(frozen.index(n))
        plain = P.replaced(plain, n, P.op("seq", P.act(begin), P.act(end)))
    aligner = Aligner(tree)
    traces = [_projected(_aligned(aligner, t), tree, frozen) for t in [*added, trace]]
    now = add_trace(plain, traces[:-1], traces[-1], pull_down)
    for k in range(len(frozen)):
        now = _put_back(now, k, traces)
        traces = [tuple(x for x in t if x not in _marks(k)) for t in traces]
    now = P.reduced(now)
    return _with_leaves(now, {P.act(_marks(k)[2]): part for k, part in enumerate(parts)})


def _with_leaves(tree: P.Tree, new: dict[P.Tree, P.Tree]) -> P.Tree:
    return (tree[0], tuple(_with_leaves(c, new) for c in tree[1])) if P.children(tree) else new.get(tree, tree)


def _put_back(tree: P.Tree, k: int, traces: list[tuple[str, ...]]) -> P.Tree:
    """The tree with the k-th frozen part's own mark in place of the begins and ends of its runs."""
    begin, end, mark = map(P.act, _marks(k))
    nodes = P.nodes(tree)
    at = [n for n, t in enumerate(nodes) if t in (begin, end)]
    if not at:  # no trace runs it
        return P.op("and", tree, P.op("xor", P.TAU, mark))
    lowest = P.common_ancestor(tree, at)
    above = nodes[lowest]
    if len(at) == 2 and above[0] == "seq":
        parts = above[1]
        i = parts.index(begin) if begin in parts else -1
        if i >= 0 and parts[i + 1 : i + 2] == (end,):
            made = (*parts[:i], mark, *parts[i + 2 :])
            return P.replaced(tree, lowest, made[0] if len(made) == 1 else ("seq", made))
    if not P.children(above):
        lowest = max(P.parents(tree)[lowest], 0)
        above = nodes[lowest]
    # parts that were put back before take no part in the traces any more
    aligner = Aligner(_with_leaves(tree, {P.act(_marks(j)[2]): P.TAU for j in range(k)}))
    runs = [r.count(begin[1]) for t in traces for r in runs_of_node(_aligned(aligner, t), aligner.tree, lowest)]
    rest = _with_leaves(above, {begin: P.TAU, end: P.TAU})
    return P.replaced(tree, lowest, P.op("and", rest, by_cardinality(mark, runs)))


def _projected(own, tree: P.Tree, frozen: list[int]) -> tuple[str, ...]:
    """A trace with begins and ends of whole runs of frozen parts in place of what it does in them. Where it leaves
    out something that a run would need, it doesn't run the part, and what it does stays."""
    inside = {k: n for n in frozen for k in range(n, n + P.size(P.nodes(tree)[n]))}
    out: dict[int, str] = {i: m.activity for i, m in enumerate(own.moves) if m.kind in (SYNC, LOG)}
    for n in frozen:
        begin, end, _ = _marks(frozen.index(n))
        if not P.children(P.nodes(tree)[n]):
            for i, m in enumerate(own.moves):
                if m.node == n and m.kind == SYNC:
                    out[i] = (begin, end)
                elif m.node == n and m.kind == TAU:
                    out[i] = (begin, end)
            continue
        opened = None
        for i, m in enumerate(own.moves):
            if m.node != n:
                continue
            if m.phase == "active":
                opened = i
            elif m.phase == "closed" and opened is not None:
                run = [j for j in range(opened, i + 1) if inside.get(own.moves[j].node) == n]
                if not any(own.moves[j].kind == MODEL for j in run):
                    for j in run:
                        out.pop(j, None)
                    out[opened], out[i] = begin, end
                opened = None
    return tuple(x for i in sorted(out) for x in (out[i] if isinstance(out[i], tuple) else (out[i],)))


# Repair by sub-processes


def sub_traces(tree: P.Tree, log: Log) -> dict[int, Log]:
    """What the log alone does, by the number of the node before it (-1: at the start)."""
    aligner = Aligner(tree)
    out: dict[int, Log] = defaultdict(Counter)
    for trace, n in log.items():
        place, now = -1, []
        for m in [*_aligned(aligner, trace).moves, None]:
            if m is not None and m.kind == LOG:
                now.append(m.activity)
                continue
            if m is None or m.kind in (SYNC, MODEL):
                if now:
                    out[place][tuple(now)] += n
                    now = []
                if m is not None:
                    place = m.node
    return out


def similar_groups(traces: Log, least: float = 0.5) -> list[Log]:
    """Sub-traces whose labels overlap by at least this share with some other of their group."""
    groups: list[Log] = []
    for t, n in sorted(traces.items(), key=lambda x: (-x[1], x[0])):
        near = [g for g in groups if any(len(set(t) & set(u)) >= least * len(set(t) | set(u)) for u in g)]
        merged = Counter({t: n})
        for g in near:
            merged += g
            groups.remove(g)
        groups.append(merged)
    return groups


def repair(tree: P.Tree, log: Log, drop_at_most: int = 0, least: float = 0.5) -> P.Tree:
    """The tree with what the log does besides as optional sub-processes where it happens, with activities that
    some cases leave out made optional, and without those that at most ``drop_at_most`` cases do. Without
    dropping, every sequence of the log fits."""
    aligner = Aligner(tree)
    done, left_out = Counter(), set()
    for trace, n in log.items():
        for m in _aligned(aligner, trace).moves:
            if m.kind == SYNC:
                done[m.node] += n
            elif m.kind == MODEL:
                left_out.add(m.node)
    extra = {at: [mine(g) for g in similar_groups(x, least)] for at, x in sub_traces(tree, log).items()}
    dropped = {i for i, t in enumerate(P.nodes(tree)) if t[0] == "act" and done[i] <= drop_at_most} if drop_at_most else set()
    count = -1

    def optional(at: int) -> list[P.Tree]:
        return [P.op("xor", P.TAU, *extra[at])] if at in extra else []

    def run(t: P.Tree) -> P.Tree:
        nonlocal count
        count += 1
        me = count
        if P.children(t):
            return (t[0], tuple(run(c) for c in t[1]))
        new = P.TAU if me in dropped else P.op("xor", t, P.TAU) if me in left_out and t != P.TAU else t
        return P.op("seq", new, *optional(me)) if me in extra else new

    return P.reduced(P.op("seq", *optional(-1), run(tree)))


def repair_log(tree: P.Tree, log: DataFrame, drop_at_most: int = 0, most_variants: int = MOST_VARIANTS) -> P.Tree:
    return repair(tree, counted(log, most_variants), drop_at_most)
