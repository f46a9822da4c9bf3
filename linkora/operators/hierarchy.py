"""A class hierarchy as arrays that every task reads, and searches over many classes at once.

Classes have numbers. A class of scope is higher than all that is above it, so a search goes from the highest class down and meets each
class once; a hierarchy with a cycle, or deeper than DEEP, has no heights and is walked by `closure`, one start at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.flags import OBJECT, OBJECT_METHODS

DEEP = 4096
BUILT_IN = pa.array([a + d for a, d in OBJECT_METHODS])
CTORS = pa.array(["<init>", "<clinit>"])


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _hash(text: pa.Array, seed: int) -> np.ndarray:
    """64 bits for each string; only a way to find a name, which is then compared."""
    raw = text.cast(pa.large_binary())
    if not len(raw) or raw.buffers()[2] is None:
        return np.full(len(raw), seed, np.uint64)
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    at, short = off[:-1][order], -size[order]
    h = np.full(len(raw), seed, np.uint64)
    for p in range(int(-short[0])):
        n = int(np.searchsorted(short, -p, "left"))
        h[:n] = (h[:n] ^ data[at[:n] + p]) * np.uint64(0x100000001B3)
        h[:n] ^= h[:n] >> np.uint64(31)
    out = np.empty_like(h)
    out[order] = h
    return out


def ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (size[0] of them), lo[1], ..."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(lo) else np.zeros(0, np.int64)


@dataclass
class Hierarchy:
    """Classes by number: those of scope come first. ups: interfaces in order, then the superclass, from at[i] to at[i + 1]."""

    names: pa.Array
    supers: np.ndarray
    at: np.ndarray
    ups: np.ndarray
    faces: np.ndarray  # how many of the ups are interfaces
    height: np.ndarray | None = None  # 0 out of scope, else above that of all ups
    out: np.ndarray | None = None  # does a walk up leave the scope?
    face: np.ndarray | None = None  # is the class of scope an interface?
    seed: int = 1469598103934665603
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    @classmethod
    def of(cls, rows: pa.Table) -> Hierarchy:
        """rows (class_name, super_name, interfaces), without Object; of several rows of a class the first counts."""
        name, sup = (flat(rows.column(c)).cast(pa.string()) for c in ("class_name", "super_name"))
        faces = flat(rows.column("interfaces"))
        off = faces.offsets.to_numpy().astype(np.int64)
        off, values = off - off[0], faces.flatten().cast(pa.string())
        coded = pa.concat_arrays([name, sup, values]).dictionary_encode()
        code, names = coded.indices.fill_null(-1).to_numpy().astype(np.int32), coded.dictionary
        del coded
        n, m = len(name), int(code[: len(name)].max(initial=-1)) + 1
        first = np.full(m, n, np.int64)
        np.minimum.at(first, code[:n], np.arange(n))
        supers, size, own = code[n : 2 * n][first], np.diff(off)[first], code[2 * n :]
        at = np.concatenate([[0], np.cumsum(size + (supers >= 0))]).astype(np.int32)
        ups = np.empty(int(at[-1]), np.int32)
        ups[ranges(at[:-1], size)] = own[ranges(off[:-1][first], size)]
        ups[(at[1:] - 1)[supers >= 0]] = supers[supers >= 0]
        h = cls(names, supers, at, ups, size.astype(np.int32))
        if "face" in rows.column_names:
            h.face = flat(rows.column("face")).fill_null(False).to_numpy(zero_copy_only=False)[first]
        h._heights()
        while len(names):
            got = _hash(names, h.seed)
            h.order = np.argsort(got, kind="stable").astype(np.int32)
            h.hashes = got[h.order]
            if not (h.hashes[1:] == h.hashes[:-1]).any():
                break
            h.seed += 2
        return h

    def _heights(self) -> None:
        n, m = len(self.names), len(self.supers)
        height, out, left = np.zeros(n, np.int16), np.ones(n, bool), np.arange(m)
        height[:m], out[:m] = -1, False
        for level in range(1, DEEP):
            if not len(left):
                self.height, self.out = height, out
                return
            size = np.diff(self.at)[left]
            ups, of = self.ups[ranges(self.at[left], size)], np.repeat(np.arange(len(left)), size)
            ready = np.bincount(of[height[ups] < 0], minlength=len(left)) == 0
            if not ready.any():
                return
            out[left[np.bincount(of[out[ups]], minlength=len(left)) > 0]] = True
            height[left[ready]] = level
            left = left[~ready]

    def codes(self, text: pa.Array) -> np.ndarray:
        """The number of each name, -1 where it is none."""
        text = flat(text).cast(pa.string())
        if not len(self.names) or not len(text):
            return np.full(len(text), -1, np.int64)
        h = _hash(text, self.seed)
        c = self.order[np.minimum(np.searchsorted(self.hashes, h), len(self.names) - 1)]
        same = pc.equal(self.names.take(pa.array(c)), text).fill_null(False).to_numpy(zero_copy_only=False)
        return np.where(same, c, -1).astype(np.int64)

    def known(self, c: int) -> bool:
        return c < len(self.supers)

    def interfaces(self, c: int) -> list[int]:
        return self.ups[self.at[c] : self.at[c] + self.faces[c]].tolist()

    def above(self, c: int) -> list[int]:
        return self.ups[self.at[c] : self.at[c + 1]].tolist()

    def degree(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ups of each class begin, and how many there are."""
        scope = c < len(self.supers)
        lo = self.at[np.where(scope, c, 0)] if len(self.supers) else np.zeros(len(c), np.int64)
        return lo, np.where(scope, self.at[np.where(scope, c + 1, 0)] - lo, 0) if len(self.supers) else np.zeros(len(c), np.int64)

    def reach(self, states: np.ndarray, ends=lambda states: np.zeros(len(states), bool)) -> Iterator[np.ndarray]:
        """states (row * len(names) + class) -> all that is met going up, themselves included, each once and the highest first.

        What `ends` says of states is not walked on from.
        """
        n, waits = len(self.names), {}

        def wait(states: np.ndarray) -> None:
            tall = self.height[states % n]
            order = np.argsort(tall, kind="stable")
            states, tall = states[order], tall[order]
            cut = np.flatnonzero(np.diff(tall)) + 1
            for part, t in zip(np.split(states, cut), tall[np.concatenate([[0], cut])] if len(tall) else []):
                waits.setdefault(int(t), []).append(part)

        wait(states)
        while waits:
            here = np.unique(np.concatenate(waits.pop(max(waits))))
            yield here
            on = here[~ends(here)]
            lo, size = self.degree(on % n)
            if size.any():
                wait(np.repeat(on // n, size) * n + self.ups[ranges(lo, size)])

    def reached(self, starts: np.ndarray) -> np.ndarray:
        """Whether each class is a start or above one; cycles may be."""
        seen, todo = np.zeros(len(self.names), bool), np.unique(starts)
        while len(todo):
            seen[todo] = True
            lo, size = self.degree(todo)
            ups = np.unique(self.ups[ranges(lo, size)])
            todo = ups[~seen[ups]]
        return seen

    def reaching(self, ends: np.ndarray) -> np.ndarray:
        """Whether each class is an end or below one; cycles may be."""
        hit = np.zeros(len(self.names), bool)
        hit[ends] = True
        of, left = np.repeat(np.arange(len(self.supers)), np.diff(self.at)), np.ones(len(self.ups), bool)
        of, ups = of, self.ups
        while True:
            left = ~hit[of]
            of, ups = of[left], ups[left]
            more = of[hit[ups]]
            if not len(more):
                return hit
            hit[more] = True

    def chain(self, start: int) -> Iterator[tuple[int, int]]:
        """(class, depth) up the superclasses, until the scope or a cycle ends."""
        seen, c = set(), start
        while c >= 0 and c not in seen:
            yield c, len(seen)
            seen.add(c)
            c = int(self.supers[c]) if self.known(c) else -1

    def above_of(self, c: np.ndarray) -> np.ndarray:
        """The superclass of each class, -1 where there is none."""
        scope = (c >= 0) & (c < len(self.supers))
        return np.where(scope, self.supers[np.where(scope, c, 0)], -1).astype(np.int64) if len(self.supers) else np.full(len(c), -1, np.int64)


PART = 8 << 20


def pack(tree: Hierarchy) -> Iterator[bytes]:
    """The hierarchy as parts of bytes, made in a task, so that the driver only hands them on."""
    raw = pickle.dumps(tree, protocol=5)
    small = pa.compress(raw, codec="lz4", asbytes=True)
    yield pickle.dumps((tree.height is not None, len(raw)))
    del raw
    for at in range(0, len(small), PART):
        yield small[at : at + PART]


class Packed:
    """Parts of `pack` as they are broadcast; each process opens them once."""

    def __init__(self, parts: list[bytes]):
        (self.tall, self.size), self.parts, self.opened = pickle.loads(parts[0]), parts[1:], None

    def tree(self) -> Hierarchy:
        if self.opened is None:
            self.opened = pickle.loads(pa.decompress(b"".join(self.parts), decompressed_size=self.size, codec="lz4"))
            self.parts = []
        return self.opened


def _find(states: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each state in a sorted array, -1 where it is not there."""
    if not len(among):
        return np.full(len(states), -1, np.int64)
    i = np.minimum(np.searchsorted(among, states), len(among) - 1)
    return np.where(among[i] == states, i, -1)


def _first(values: np.ndarray, lo: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each range of `at`, the first value there that is not -1."""
    out = np.full(len(lo), -1, np.int64)
    for j in range(int(size.max(initial=0)) - 1, -1, -1):
        has = np.flatnonzero(size > j)
        v = values[at[lo[has] + j]]
        out[has[v >= 0]] = v[v >= 0]
    return out


def _any(values: np.ndarray, lo: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _first(np.where(values, 0, -1), lo, size, at) >= 0


def _decided(h: Hierarchy, asked: np.ndarray, ends: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """What is met going up from `asked`, not beyond the sorted `ends`: the sorted states, whether each is an end, how many ups each is walked on
    to, where their places begin in `links`, those places, and the states that have ups in groups, such that ups come in earlier groups.
    """
    n = max(len(h.names), 1)
    levels = list(h.reach(asked)) if ends is None else list(h.reach(asked, lambda s: _find(s, ends) >= 0))
    states = np.concatenate([np.zeros(0, np.int64), *levels])
    by = np.argsort(states, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    states = states[by]
    here = _find(states, ends) >= 0 if ends is not None else np.zeros(len(states), bool)
    lo, size = h.degree(states % n)
    size = np.where(here, 0, size)
    start = np.cumsum(size) - size
    links = _find(np.repeat(states // n, size) * n + h.ups[ranges(lo, size)], states)
    groups = np.split(place, np.cumsum([len(x) for x in levels])[:-1])[::-1] if levels else []
    return states, here, size, start, links, [x[size[x] > 0] for x in groups]


def _keyed(h: Hierarchy, wanted: pa.Table, owner: str, declared: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States of (name, descriptor) and class: of wanted (-1: the owner is not known, or a part is null), key of wanted; of declared, with its rows."""
    n, both = len(wanted), []
    for c in ("name", "descriptor"):
        coded = pa.concat_arrays([flat(wanted.column(c)).cast(pa.string()), flat(declared.column(c)).cast(pa.string())]).dictionary_encode()
        both.append((coded.indices.fill_null(-1).to_numpy().astype(np.int64), len(coded.dictionary) + 1))
    null = (both[0][0] < 0) | (both[1][0] < 0)
    key = np.unique(both[0][0] * both[1][1] + both[1][0], return_inverse=True)[1]
    key[null] = -1
    size = len(h.names)

    def states(classes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.where((classes >= 0) & (keys >= 0), keys * size + classes, -1)

    asked, own = states(h.codes(wanted.column(owner)), key[:n]), states(h.codes(declared.column("class_name")), key[n:])
    return asked, key[:n], own[own >= 0], np.flatnonzero(own >= 0)


def resolve(h: Hierarchy, wanted: pa.Table, declared: pa.Table, method: bool) -> pa.Table:
    """wanted (owner, name, descriptor) and declared (class_name, name, descriptor, access) -> status, at, access, for a hierarchy with heights.

    What a class resolves follows from what its ups resolve, so each class is decided once for a key, after all that is above it.
    """
    n, m = max(len(h.names), 1), len(h.supers)
    asked, key, own, rows = _keyed(h, wanted, "owner", declared)
    access = flat(declared.column("access")).to_numpy(zero_copy_only=False)[rows]
    order = np.lexsort((access, own))
    own, access = own[order], access[order]
    keep = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    own, access = own[keep], access[keep]
    name, owner = flat(wanted.column("name")).cast(pa.string()), flat(wanted.column("owner")).cast(pa.string())
    ctor = pc.is_in(name, CTORS).to_numpy(zero_copy_only=False) if method else np.zeros(len(asked), bool)
    # Object is no place, and a null names none; an owner that nothing names is out of scope.
    none = pc.equal(owner, OBJECT).fill_null(True).to_numpy(zero_copy_only=False) | (key < 0)
    alone, go = ~none & (asked < 0), ~none & (asked >= 0)
    at = np.full(len(asked), -1, np.int64)
    blind = alone.copy()  # unknown
    only = np.flatnonzero(go & ctor)
    c = asked[only] % n
    at[only] = np.where((_find(asked[only], own) >= 0) & (c < m), c, -1)
    blind[only] = c >= m
    walk = np.flatnonzero(go & ~ctor)
    states, here, size, start, links, order = _decided(h, asked[walk], own)
    cls = states % n
    far = cls >= m
    faces = np.where(size > 0, h.faces[np.where(far, 0, cls)] if m else 0, 0)
    event = np.where(here | far, cls, -1)
    if method:
        a, f, o = event.copy(), np.where(here, cls, -1), far.copy()
        b, bo = np.full(len(states), -1, np.int64), np.zeros(len(states), bool)
    for x in order:
        if not method:
            event[x] = _first(event, start[x], size[x], links)
            continue
        f[x], o[x] = _first(f, start[x], faces[x], links), o[x] | _any(o, start[x], faces[x], links)
        b[x], bo[x] = _first(f, start[x], faces[x], links), _any(o, start[x], faces[x], links)
        up = x[size[x] > faces[x]]
        s = links[start[up] + size[up] - 1]
        a[up], bo[up], b[up] = a[s], bo[up] | bo[s], np.where(b[up] >= 0, b[up], b[s])
    i = _find(asked[walk], states)
    if not method:
        at[walk], blind[walk] = np.where(event[i] < m, event[i], -1), event[i] >= m
    else:
        built_in = pc.is_in(pc.binary_join_element_wise(name, flat(wanted.column("descriptor")).cast(pa.string()), ""), BUILT_IN).to_numpy(zero_copy_only=False) & ~ctor
        first, object_ = a[i] >= 0, built_in[walk]
        at[walk] = np.where(first, np.where(a[i] < m, a[i], -1), np.where(object_, -1, b[i]))
        blind[walk] = np.where(first, a[i] >= m, ~object_ & (b[i] < 0) & bo[i])
    found = at >= 0
    k = _find(np.where(found, key * n + at, -1), own)
    names = h.names.take(pa.array(at, mask=~found)) if len(h.names) else pa.nulls(len(at), pa.string())
    shown = np.where(k >= 0, access[k] if len(access) else 0, 0)
    if method:
        object_ = built_in & ~found & ~blind & (none | go)
        names = pc.if_else(pa.array(object_), pa.scalar(OBJECT), names)
        found, shown = found | object_, np.where(object_, 1, shown)
    status = np.where(found, "found", np.where(blind, "unknown", "not_found"))
    return pa.table({"owner": owner, "name": name, "descriptor": flat(wanted.column("descriptor")).cast(pa.string()), "status": pa.array(status.tolist(), pa.string()), "at": names.cast(pa.string()), "access": pa.array(shown.astype(np.int32), mask=~found)})


def _escapes(h: Hierarchy) -> tuple[np.ndarray, np.ndarray]:
    """Does a walk from each class leave the scope through a type outside java/, through one of java/? Found once for a hierarchy."""
    if getattr(h, "_left", None) is None:
        java, far = pc.starts_with(h.names, "java/").to_numpy(zero_copy_only=False), np.arange(len(h.names)) >= len(h.supers)
        h._left = h.reaching(np.flatnonzero(far & ~java)), h.reaching(np.flatnonzero(far & java))
    return h._left


def evidence(h: Hierarchy, breaks: pa.Table, calls: pa.Table) -> pa.Table:
    """breaks (class_name, name, descriptor), calls (owner, name, descriptor) -> the breaks that a call may run on; no pairs are made.

    The owner of a call is the class, above it or below it; or a walk from either leaves the scope and may hide the other. A walk that
    leaves it through types of java/ alone hides only names of java/.
    """
    asked, _, called, _ = _keyed(h, breaks, "class_name", calls.rename_columns(["class_name" if c == "owner" else c for c in calls.column_names]))
    both = [pc.binary_join_element_wise(flat(t.column("name")).cast(pa.string()), flat(t.column("descriptor")).cast(pa.string()), "\x00") for t in (breaks, calls)]
    coded = pa.concat_arrays(both).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    key, call_key = coded[: len(breaks)], coded[len(breaks) :]
    top = int(coded.max(initial=-1)) + 2  # a null is last
    java = [pc.starts_with(flat(c).cast(pa.string()), "java/").fill_null(False).to_numpy(zero_copy_only=False) for c in (breaks.column("class_name"), calls.column("owner"))]

    def leaves(names: pa.Array, java: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = h.codes(names)
        other, platform = (np.append(x, False) for x in _escapes(h))
        return np.where(c < 0, ~java, other[c]), np.where(c < 0, java, platform[c])

    def keys(which: np.ndarray) -> np.ndarray:
        out = np.zeros(top, bool)
        out[call_key[which]] = True
        out[-1] = False
        return out[key]

    (c_other, c_platform), (o_other, o_platform) = leaves(breaks.column("class_name"), java[0]), leaves(calls.column("owner"), java[1])
    found = keys(o_other) | (c_other & keys(np.ones(len(calls), bool))) | (c_platform & keys(java[1])) | (java[0] & keys(o_platform))
    called, go = np.unique(called), np.flatnonzero(asked >= 0)
    above = np.sort(np.concatenate([np.zeros(0, np.int64), *h.reach(called)]))
    found[go] |= _find(asked[go], above) >= 0
    states, hit, size, start, links, order = _decided(h, asked[go], called)
    for x in order:
        hit[x] |= _any(hit, start[x], size[x], links)
    found[go] |= hit[_find(asked[go], states)]
    return breaks.select(["class_name", "name", "descriptor"]).filter(pa.array(found))


def selected(h: Hierarchy, wanted: pa.Table, declared: pa.Table) -> pa.Table:
    """wanted (start, name, descriptor), declared (class_name, name, descriptor, abstract) -> status of what the start selects.

    First the superclass chain; then the interfaces of the whole closure, of which the concrete ones that no other concrete one is below count.
    """
    n, m = max(len(h.names), 1), len(h.supers)
    asked, _, own, rows = _keyed(h, wanted, "start", declared)
    abstract = flat(declared.column("abstract")).to_numpy(zero_copy_only=False)[rows].astype(bool)
    solid, vague = np.unique(own[~abstract]), np.unique(own[abstract])
    states, _, size, start, links, order = _decided(h, asked[asked >= 0], None)
    cls = states % n
    far, con, abs_ = cls >= m, _find(states, solid) >= 0, _find(states, vague) >= 0
    # 0 concrete, 1 abstract, 2 out of scope, -1 nothing yet
    first = np.where(far, 2, np.where(con, 0, np.where(abs_, 1, -1)))
    counts = far | (h.face[np.where(far, 0, cls)] if m else False)
    own_out, own_con, own_abs = far, con & counts, abs_ & counts
    out, some, none = own_out.copy(), own_con.copy(), own_abs.copy()  # of the class and all above it
    up_out, up_some, up_none = (np.zeros(len(states), bool) for _ in range(3))  # of what is above it
    supers = np.where(far, -1, h.supers[np.where(far, 0, cls)]) if m else np.full(len(states), -1)
    for x in order:
        for up, all_ in ((up_out, out), (up_some, some), (up_none, none)):
            up[x] = _any(all_, start[x], size[x], links)
            all_[x] |= up[x]
        y = x[(first[x] < 0) & (supers[x] >= 0)]
        first[y] = first[links[start[y] + size[y] - 1]]
    known = asked >= 0
    i = _find(asked[known], states)
    name, descriptor = (flat(wanted.column(c)).cast(pa.string()) for c in ("name", "descriptor"))
    built_in = pc.is_in(pc.binary_join_element_wise(name, descriptor, ""), BUILT_IN).to_numpy(zero_copy_only=False)[known]
    f = first[i]
    maybe = np.flatnonzero((f < 0) & ~built_in & ~up_out[i] & ~up_none[i] & up_some[i])
    tops = _tops(h, asked[known][maybe], solid)
    many = np.zeros(len(i), bool)
    many[maybe] = tops > 1
    status = np.select(
        [f == 0, f == 1, f == 2, built_in, up_out[i] | (up_none[i] & up_some[i]), up_none[i], ~up_some[i], many],
        ["concrete", "abstract_only", "unknown", "concrete", "unknown", "abstract_only", "absent", "conflict"],
        "concrete",
    )
    # A start that nothing names is out of scope; a null has nothing.
    null = (flat(wanted.column("start")).is_null().to_numpy(zero_copy_only=False)) | pc.is_null(pc.binary_join_element_wise(name, descriptor, "")).to_numpy(zero_copy_only=False)
    shown = np.where(null, "absent", "unknown").astype(object)
    shown[known] = status
    return pa.table({"start": flat(wanted.column("start")).cast(pa.string()), "name": name, "descriptor": descriptor, "status": pa.array(shown.tolist(), pa.string())})


def _tops(h: Hierarchy, asked: np.ndarray, solid: np.ndarray, most: int = 2000) -> np.ndarray:
    """How many concrete interfaces above each asked state are below all others that it meets; classes between them are walked through."""
    n, out = max(len(h.names), 1), np.zeros(len(asked), np.int64)

    def ends(key: np.ndarray, states: np.ndarray) -> np.ndarray:
        return (_find(key[states // n] * n + states % n, solid) >= 0) & (h.face[np.minimum(states % n, len(h.supers) - 1)])

    for at in range(0, len(asked), most):
        key, c = asked[at : at + most] // n, asked[at : at + most] % n
        met = np.concatenate([np.zeros(0, np.int64), *h.reach(np.arange(len(c)) * n + c, lambda s: ends(key, s))])  # noqa: B023
        met = np.sort(met[ends(key, met)])
        count = np.bincount(met // n, minlength=len(c))
        several = met[count[met // n] > 1]
        row, hidden = several // n, [np.zeros(0, np.int64)]
        for part in range(0, len(several), most):
            x = np.arange(part, min(part + most, len(several)))
            for up in h.reach(x * n + several[x] % n):
                other = row[up // n] * n + up % n
                other = other[up % n != several[up // n] % n]
                hidden.append(other[_find(other, several) >= 0])
        gone = np.unique(np.concatenate(hidden))
        out[at : at + most] = count - np.bincount(gone // n, minlength=len(c))
    return out
