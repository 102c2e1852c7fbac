"""Beams and their answers on numbered nodes, a block of queries at a time in Arrow workers.

For tables whose nodes are a kind and a number (``order:17``) a node is one long, ``number * 16 + kind``, and a row of a table may
stand for several edges from its source.  The rows are shuffled once by the queries' seeds; edges of later hops lie as sorted
arrays in the shared folder, which workers map.  Scores, caps, ties (the order of the paths' texts included) and answers are those
of ``traversal.beam`` and ``answers.extract``; texts are made only of what a query selects.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.functions import scoring as S
from graphloom.storage import drop, materialize_parts, shared_path, slices

#: Queries of a block, rows of a task, and rows that a file of a later hop's edges is made of.
BLOCK, TASK_ROWS, FILE_ROWS = 1 << 14, 250_000, 1_000_000
#: Numbers stay below it, so that a node's text order fits 48 bits.
MOST = 10**11
_TENS = 10 ** np.arange(13, dtype=np.int64)
_BARE = ("", "triples", "manual", "unknown")


@dataclass(frozen=True)
class Edge:
    """What a row stands for: an edge to its column ``to`` (a or b), of a fixed confidence or that of its column ``c``."""

    rel: str
    kind: str
    to: str = "a"
    confidence: float | None = None
    provenance: str = ""
    distinct: bool = False


@dataclass(frozen=True)
class Part:
    """Rows of a table: src, a, b (numbers), c (confidence), w (weight), t (validity's begin); absent ones are not read."""

    rows: DataFrame
    kind: str
    edges: tuple[Edge, ...]


class Names:
    """Codes of kinds and relations in the order of their texts, and the edges' constants by their number."""

    def __init__(self, parts: list[Part], relation_weights: dict[str, float]):
        self.edges = [e for p in parts for e in p.edges]
        self.kinds = sorted({p.kind for p in parts} | {e.kind for e in self.edges}, key=lambda k: k + ":")
        self.code = {k: i for i, k in enumerate(self.kinds)}
        by = lambda end: {r: i for i, r in enumerate(sorted({e.rel for e in self.edges}, key=lambda r: r + end))}
        self.in_path = np.array([by("|")[e.rel] for e in self.edges], dtype=np.int64)
        self.alone = np.array([by("")[e.rel] for e in self.edges], dtype=np.int64)
        self.distinct = np.array([e.distinct for e in self.edges])
        self.bare = np.array([e.provenance in _BARE for e in self.edges], dtype=np.int64)
        self.relation = np.array([float(relation_weights.get(e.rel, 0.0)) for e in self.edges])
        self.trust = np.array([next((v for n, v in S.CREDIBILITY.items() if e.provenance.startswith(n)), S.OTHER_CREDIBILITY) for e in self.edges])

    def text(self, code: Column) -> Column:
        """A node's id."""
        kind = F.element_at(F.array(*[F.lit(k + ":") for k in self.kinds]), (code.bitwiseAND(15) + 1).cast("int"))
        return F.concat(kind, F.shiftright(code, 4).cast("string"))

    def relation_of(self, number: Column) -> Column:
        return F.get(F.array(*[F.lit(e.rel) for e in self.edges]), number.cast("int"))


def layers(parts: list[Part], seed: str, hops: int) -> list[list[int]] | None:
    """The parts that hold each hop's edges by their kinds; none if a path could come back to a kind, and so to a node."""
    trails, out = {(seed,)}, []
    for _ in range(hops):
        out.append([i for i, p in enumerate(parts) if p.kind in {t[-1] for t in trails}])
        trails = {(*t, e.kind) for t in trails for p in parts if p.kind == t[-1] for e in p.edges}
        if any(t[-1] in t[:-1] for t in trails):
            return None
    return out


def fits(parts: list[Part], seeds: DataFrame, relation_weights: dict[str, float]) -> list[int] | None:
    """The parts' rows and the seeds', if all numbers are whole and in range and no value is missing; else none."""
    whole = lambda df, *names: all(df.schema[n].dataType.typeName() in ("byte", "short", "integer", "long") for n in names)
    if any(v < 0 for v in relation_weights.values()) or len({p.kind for p in parts} | {e.kind for p in parts for e in p.edges}) > 16:
        return None
    frames = None
    for i, df in enumerate([*(p.rows for p in parts), seeds]):
        numbers = [n for n in ("src", "a", "b") if n in df.columns]
        if not whole(df, *numbers):
            return None
        ok = F.lit(True)
        for n in numbers:
            ok = ok & F.col(n).between(0, MOST - 1)
        for n in ("c", "w"):
            if n in df.columns:
                ok = ok & F.col(n).between(0.0, 1e9)
        got = df.select(F.lit(i).alias("i"), F.coalesce(ok, F.lit(False)).alias("ok")).groupBy("i").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("good"))
        frames = got if frames is None else frames.unionByName(got)
    found = {r.i: r for r in frames.collect()}
    if any(r.n != r.good for r in found.values()):
        return None
    return [found[i].n if i in found else 0 for i in range(len(parts) + 1)]


def digits(v: np.ndarray) -> np.ndarray:
    return np.searchsorted(_TENS[1:], v, side="right") + 1


def text_key(codes: np.ndarray, ended: bool) -> np.ndarray:
    """48 bits in the order of the ids' texts, each followed by the text's end or by ``|``."""
    v = codes >> 4
    k = digits(v)
    p = _TENS[12 - k]
    low = ((v * p) << 4) | k if ended else ((v * p + p - 1) << 4) | (15 - k)
    return ((codes & 15) << 44) | low


def rounded(x: np.ndarray, scale: float) -> np.ndarray:
    """Whole numbers of 1/scale."""
    return np.floor(x * scale + 0.5).astype(np.int64)


def ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each low on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - count), count)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted row differs from the one before."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def read(batches: Iterable[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """All columns of a task; a missing double is the least of all."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return {}
    t = pa.Table.from_batches(kept)
    out = {}
    for name in t.column_names:
        col = t.column(name)
        if col.null_count:
            col = col.fill_null(float("-inf") if pa.types.is_floating(col.type) else -1)
        out[name] = col.to_numpy()
    return out


def edge_arrays(rows: dict[str, np.ndarray], parts: dict[int, list[tuple[int, Edge]]], names: Names, most: int) -> dict[str, np.ndarray]:
    """The rows' edges, capped for each source in the order of ``access.cap_per_node``; sorted by source, relation and end."""
    got: dict[str, list[np.ndarray]] = {k: [] for k in ("src", "dst", "conf", "w", "t", "e")}
    for part, edges in parts.items():
        at = np.flatnonzero(rows["p"] == part)
        for number, e in edges:
            code = rows[e.to][at] * 16 + names.code[e.kind]
            got["src"].append(rows["src"][at])
            got["dst"].append(code)
            got["conf"].append(rows["c"][at] if e.confidence is None else np.full(len(at), e.confidence))
            for k in ("w", "t"):
                got[k].append(rows[k][at] if k in rows and e.confidence is None else np.zeros(len(at)))
            got["e"].append(np.full(len(at), number, dtype=np.int8))
    x = {k: np.concatenate(v) for k, v in got.items()}
    key = text_key(x["dst"], True)
    order = np.lexsort(((key << 6) | names.alone[x["e"]], x["src"]))
    x, key = {k: v[order] for k, v in x.items()}, key[order]
    if names.distinct[x["e"]].any():
        again = ~starts(x["src"], x["dst"], x["e"]) & names.distinct[x["e"]]
        x, key = {k: v[~again] for k, v in x.items()}, key[~again]
    first = np.flatnonzero(starts(x["src"]))
    count = np.diff(np.append(first, len(key)))
    many = np.repeat(count > most, count)
    if many.any():
        at = np.flatnonzero(many)
        at = at[np.lexsort((x["conf"][at], x["w"][at], x["t"][at], names.alone[x["e"][at]], key[at], x["src"][at]))]
        low = np.flatnonzero(starts(x["src"][at]))
        n = np.diff(np.append(low, len(at)))
        kept = at[(np.arange(len(at)) - np.repeat(low, n)) < most]
        keep = np.sort(np.concatenate([np.flatnonzero(~many), kept]))
        x, key = {k: v[keep] for k, v in x.items()}, key[keep]
    x["key"] = (names.in_path[x["e"]] << 48) | key
    order = np.lexsort((x["key"], x["src"]))
    return {k: x[k][order] for k in ("src", "dst", "conf", "e", "key")}


def edge_weight(conf: np.ndarray, e: np.ndarray, hop: int, names: Names) -> np.ndarray:
    """The logistic weight of ``traversal.extend`` without communities."""
    logit = 0.0 + S.WEIGHTS["cs"] * 0.5 + S.WEIGHTS["etw"] * names.relation[e] + S.WEIGHTS["hd"] * (1.0 / (1.0 + hop)) + S.WEIGHTS["grounding"] * (names.trust[e] * conf)
    return 1.0 / (1.0 + np.exp(-logit))


def best_edges(x: dict[str, np.ndarray], hop: int, width: int, names: Names) -> dict[str, np.ndarray]:
    """Edges that may be among a source's best ``width``, whatever score the path before has: those within 1e-6 of the last of
    them, scores being 2**-hop at least and rounded to 1e-9; of equal weights the first by text."""
    w = edge_weight(x["conf"], x["e"], hop, names)
    order = np.lexsort((x["key"], -w, x["src"]))
    low = np.flatnonzero(starts(x["src"][order]))
    count = np.diff(np.append(low, len(order)))
    place = np.arange(len(order)) - np.repeat(low, count)
    bar = w[order][np.minimum(low + width, low + count) - 1]
    level = starts(x["src"][order], w[order])
    at = np.flatnonzero(level)
    in_level = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
    keep = order[(place < width) | ((w[order] >= np.repeat(bar, count) - 1e-6) & (in_level < width))]
    keep.sort()
    return {k: v[keep] for k, v in x.items()}


@dataclass
class Onward:
    """The edges of a later hop: files of arrays, sorted by source, of the sources whose number has a remainder."""

    path: str
    files: int

    def edges_of(self, tails: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the edges of each tail: its place, the edge's place in its source's list, end, confidence and number."""
        shard = (tails >> 4) % self.files
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.files + 1))
        out: list[tuple[np.ndarray, ...]] = []
        for i in np.flatnonzero(np.diff(cuts)):
            if not os.path.exists(f"{self.path}/{i}.src.npy"):
                continue
            src, dst, conf, e = (np.load(f"{self.path}/{i}.{n}.npy", mmap_mode="r") for n in ("src", "dst", "conf", "e"))
            at = order[cuts[i] : cuts[i + 1]]
            at = at[np.argsort(tails[at], kind="stable")]
            low, high = np.searchsorted(src, tails[at], "left"), np.searchsorted(src, tails[at], "right")
            n = high - low
            places = ranges(low, n)
            out.append((np.repeat(at, n), places - np.repeat(low, n), dst[places], conf[places], e[places]))
        if not out:
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.float64, np.int8))
        return tuple(map(np.concatenate, zip(*out)))


def rows_of(parts: list[Part], chosen: list[int], names: Names) -> DataFrame:
    """The chosen parts' rows as one frame with the part's number, sources as codes."""
    used = [n for n in ("a", "b", "c", "w", "t") if any(n in parts[i].rows.columns for i in chosen)]
    kinds = {n: "bigint" if n in "ab" else "double" for n in used}
    out = None
    for i in chosen:
        df = parts[i].rows
        value = lambda n: (F.col(n) if n in df.columns else F.lit(None)).cast(kinds[n]).alias(n)  # noqa: B023, E731
        df = df.select((F.col("src").cast("bigint") * 16 + names.code[parts[i].kind]).alias("src"), F.lit(i).cast("tinyint").alias("p"), *map(value, used))
        out = df if out is None else out.unionByName(df)
    return out


def numbered(parts: list[Part], chosen: list[int], relations: tuple[str, ...] | None = None) -> dict[int, list[tuple[int, Edge]]]:
    """Of each chosen part its edges with their numbers, of certain relations only if some are given."""
    first = np.cumsum([0] + [len(p.edges) for p in parts])
    return {i: [(int(first[i]) + j, e) for j, e in enumerate(parts[i].edges) if relations is None or e.rel in relations] for i in chosen}


def write_onward(parts: list[Part], chosen: list[int], counts: list[int], names: Names, neighbours: int, hop: int, width: int | None, relations: tuple[str, ...] | None = None) -> Onward:
    """A later hop's edges as files; ``width`` leaves out those that no beam of that width can keep."""
    rows = rows_of(parts, chosen, names)
    path = shared_path(rows.sparkSession, f"onward{hop}")
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"workers map a hop's edges, so {path} must be in a mounted folder")
    path = path.removeprefix("file://").removeprefix("file:")
    files, edges = slices(sum(counts[i] for i in chosen), FILE_ROWS), numbered(parts, chosen, relations)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = read(batches)
        if got:
            x = edge_arrays(got, edges, names, neighbours)
            x = x if width is None else best_edges(x, hop, width, names)
            shard = (x["src"] >> 4) % files
            os.makedirs(path, exist_ok=True)
            for i in np.unique(shard):
                for name in ("dst", "conf", "e", "src"):
                    with tempfile.NamedTemporaryFile(dir=path, delete=False) as f:
                        np.save(f, x[name][shard == i])
                    os.chmod(f.name, 0o644)
                    os.replace(f.name, f"{path}/{i}.{name}.npy")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x["src"])], pa.int64())})

    with storage._shuffles_freed(rows.sparkSession):
        rows.repartitionById(files, F.pmod(F.shiftright("src", 4), F.lit(files)).cast("int")).mapInArrow(write, "n bigint").collect()
    return Onward(path, files)


def extended(before: dict[str, np.ndarray], at: np.ndarray, place: np.ndarray, dst: np.ndarray, conf: np.ndarray, e: np.ndarray, hop: int, names: Names) -> dict[str, np.ndarray]:
    """Paths longer by an edge each."""
    w = edge_weight(conf, e, hop, names)
    x = {k: v[at] for k, v in before.items()}
    x["score"] = rounded((x["score"] / 1e9) * w, 1e9)
    x["logs"] = x["logs"] + np.log(np.maximum(w, 1e-9))
    x["product"] = x["product"] * conf
    x["least"] = np.minimum(x["least"], conf)
    x["bare"] = x["bare"] + names.bare[e]
    x["ba"], x["bb"] = x["ba"] + 0.5 * w, x["bb"] + 0.5 * (1 - w)
    x[f"n{hop}"], x[f"e{hop}"] = dst, e
    x["place"] = place
    return x


def pruned(x: dict[str, np.ndarray], width: int, hop: int, names: Names) -> dict[str, np.ndarray]:
    """The best of each query; ``rank`` becomes the order of the paths' texts, each followed by ``|``."""
    order = np.argsort((x["q"] << 46) | ((np.int64(1 << 30) - x["score"]) << 15) | (x["rank"] << 8) | x["place"], kind="stable")
    low = np.flatnonzero(starts(x["q"][order]))
    n = np.diff(np.append(low, len(order)))
    keep = order[(np.arange(len(order)) - np.repeat(low, n)) < width]
    x = {k: v[keep] for k, v in x.items()}
    key = (names.in_path[x[f"e{hop}"]] << 48) | text_key(x[f"n{hop}"], False)
    order = np.lexsort((key, x["rank"], x["q"]))
    new, first = starts(x["q"][order], x["rank"][order], key[order]), starts(x["q"][order])
    dense = np.cumsum(new)
    low = np.flatnonzero(first)
    rank = np.empty_like(dense)
    rank[order] = dense - np.repeat(dense[low], np.diff(np.append(low, len(order))))
    x["rank"] = rank
    return x


def beam(seeds: np.ndarray, q: np.ndarray, local: dict[str, np.ndarray], later: list[Onward], width: int, names: Names) -> list[dict[str, np.ndarray]]:
    """The paths after each hop from seeds (codes); the last hop's are not pruned."""
    one, zero = np.ones(len(seeds)), np.zeros(len(seeds))
    paths = {"q": q, "score": np.full(len(seeds), 10**9), "logs": zero, "product": one, "least": np.full(len(seeds), np.inf), "bare": np.zeros(len(seeds), dtype=np.int64), "ba": one, "bb": one, "rank": np.zeros(len(seeds), dtype=np.int64)}
    out = []
    for hop in range(1, len(later) + 2):
        if hop == 1:
            low, high = np.searchsorted(local["src"], seeds, "left"), np.searchsorted(local["src"], seeds, "right")
            n = high - low
            places = ranges(low, n)
            found = np.repeat(np.arange(len(seeds)), n), places - np.repeat(low, n), local["dst"][places], local["conf"][places], local["e"][places]
        else:
            found = later[hop - 2].edges_of(paths[f"n{hop - 1}"])
        paths = extended(paths, *found, hop, names)
        if hop <= len(later):
            paths = pruned(paths, width, hop, names)
        out.append(paths)
    return out


def answers_of(hops: list[dict[str, np.ndarray]], seeds: np.ndarray, top_k: int, vote_weight: float, branch_bonus: float, best_path: bool, names: Names) -> dict[str, np.ndarray]:
    """``answers.extract`` over a block's paths; ``q`` numbers the query among the seeds."""
    sizes, last = [len(h["q"]) for h in hops], len(hops)
    every = lambda f: np.concatenate([f(h, i + 1) for i, h in enumerate(hops)])
    q = every(lambda h, _: h["q"])
    tail = every(lambda h, i: h[f"n{i}"])
    active = 0.4 + 0.3 + 0.2
    ps = every(lambda h, i: 0.4 * np.exp(h["logs"] / i) + 0.3 * 1.0 + 0.2 * np.clip(h["product"] * np.power(0.9, h["bare"]), 0.0, 1.0))
    ps = rounded(np.clip(ps / active, 0.0, 1.0), 1e9)
    branch = every(lambda h, i: h["n1"] if i > 1 else seeds[h["q"]])
    group = (q << 48) | text_key(tail, True)
    order = np.lexsort((branch, group))
    new = starts(group[order])
    low = np.flatnonzero(new)
    count = np.diff(np.append(low, len(order)))
    real = ps[order] / 1e9
    top = np.maximum.reduceat(ps[order], low)
    votes = np.add.reduceat(real, low)
    branches = np.add.reduceat(starts(group[order], branch[order]).astype(np.int64), low)
    gq = q[order][low]
    qlow = np.flatnonzero(starts(gq))
    most = np.repeat(np.maximum.reduceat(votes, qlow), np.diff(np.append(qlow, len(gq))))
    consensus = votes / most
    score = (1 - vote_weight) * (top / 1e9) + vote_weight * consensus
    if branch_bonus:
        score = score * np.where(branches > 1, 1 + branch_bonus * np.log1p(branches - 1), 1.0)
    raw = rounded(score, 1e8)
    by = np.argsort((gq << 32) | (np.int64(1 << 31) - raw), kind="stable")
    rank = np.arange(len(by)) - np.repeat(qlow, np.diff(np.append(qlow, len(gq)))) + 1
    by, rank = by[rank <= top_k], rank[rank <= top_k]
    out = {"q": gq[by], "rank": rank, "entity": tail[order][low][by], "score": np.minimum(raw[by] / 1e8, 1.0), "path_score": top[by] / 1e9, "consensus": consensus[by], "branches": branches[by], "paths": count[by]}
    if best_path:
        at = order[ps[order] == np.repeat(top, count)]  # of each end the paths of the greatest score, of these the first by text
        hop = np.repeat(np.arange(1, last + 1), sizes)[at]
        column = lambda name, i: np.concatenate([h[f"{name}{i}"] if f"{name}{i}" in h else np.full(len(h["q"]), -1) for h in hops])[at]
        nodes, edges = [column("n", i) for i in range(1, last + 1)], [column("e", i) for i in range(1, last + 1)]
        keys = []
        for i in range(last):
            key = np.where(hop == i + 1, text_key(np.maximum(nodes[i], 0), True), text_key(np.maximum(nodes[i], 0), False))
            keys.append(np.where(hop > i, (names.in_path[edges[i]] << 48) | key, -1))
        sort = np.lexsort((*reversed(keys), group[at]))
        sort = sort[starts(group[at][sort])][by]
        for i in range(last):
            out[f"n{i + 1}"], out[f"e{i + 1}"] = nodes[i][sort], edges[i][sort]
        a, b, least = (every(lambda h, _: h[k])[at][sort] for k in ("ba", "bb", "least"))  # noqa: B023
        out["confidence"], out["uncertainty"] = least, a * b / ((a + b) * (a + b) * (a + b + 1.0))
    return out


def reached_from(seeds: np.ndarray, q: np.ndarray, local: dict[str, np.ndarray], later: list[Onward]) -> np.ndarray:
    """Sorted pairs (a query's number shifted by 44 bits, and a node) of the nodes that edges lead to."""
    low, high = np.searchsorted(local["src"], seeds, "left"), np.searchsorted(local["src"], seeds, "right")
    level = np.unique((np.repeat(q, high - low) << 44) | local["dst"][ranges(low, high - low)])
    out = [level]
    for onward in later:
        at, _, dst, _, _ = onward.edges_of(level & ((1 << 44) - 1))
        level = np.unique((level[at] >> 44 << 44) | dst)
        out.append(level)
    return np.unique(np.concatenate(out))


def answers(parts: list[Part], seed: str, seeds: DataFrame, columns: tuple[str, ...], hops: int, width: int, neighbours: int, relation_weights: dict[str, float], top_k: int, vote_weight: float = 0.45, branch_bonus: float = 0.0, causes: tuple[str, ...] | None = None) -> DataFrame | None:
    """The answers of every seed (query_id, src: a number of kind ``seed``; a query has one), written: query_id, rank, entity and
    the columns named, those of ``answers.extract``, ``rels`` (its path's relations) and ``reached`` (whether as many edges of the
    relations ``causes`` lead to it).  None if the tables or the graph of kinds need the plan on texts."""
    chosen = layers(parts, seed, hops)
    if chosen is None or neighbours > 255 or width > 127:
        return None
    counts = fits(parts, seeds, relation_weights)
    if counts is None or seeds.schema["query_id"].dataType.typeName() != "long":
        return None
    names = Names(parts, relation_weights)
    later = [write_onward(parts, chosen[h - 1], counts, names, neighbours, h, width if h < hops else None) for h in range(2, hops + 1)]
    causal: list[Onward] = []
    if causes is not None:
        only = layers([replace(p, edges=tuple(e for e in p.edges if e.rel in causes)) for p in parts], seed, hops)
        causal = [write_onward(parts, c, counts, names, 1 << 60, h, None, causes) for h, c in enumerate(only[1:], 2) if c]
    edges, seed_part = numbered(parts, chosen[0]), len(parts)
    rows = rows_of([*parts, Part(seeds.select("src", F.col("query_id").alias("a")), seed, ())], [*chosen[0], seed_part], names)
    total = sum(counts[i] for i in chosen[0]) + counts[seed_part]
    n = slices(total, 4 * storage.SLICE_ROWS)
    tasks = slices(total // n, TASK_ROWS)
    best_path = bool({"path", "rels", "confidence", "uncertainty"} & set(columns))
    path_columns = [f"{x}{i}" for i in range(1, hops + 1) for x in "ne" if "path" in columns or (x == "e" and "rels" in columns)]
    kinds = {"query_id": "bigint", "rank": "int", "entity": "bigint", "branches": "bigint", "paths": "bigint", "seed": "bigint", "reached": "boolean"} | {c: "bigint" if c[0] == "n" else "tinyint" for c in path_columns}
    written = ["query_id", "rank", "entity", *[c for c in columns if c not in ("path", "rels")], *(["seed"] if "path" in columns else []), *path_columns]
    types = {"bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "boolean": pa.bool_(), "double": pa.float64()}

    bare = [replace(p, rows=None) for p in parts]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = read(batches)
        if not got:
            return
        at = np.flatnonzero(got["p"] == seed_part)
        at = at[np.lexsort((got["a"][at], got["src"][at]))]
        codes, ids = got["src"][at], got["a"][at]
        local = edge_arrays(got, edges, names, neighbours)
        every = edge_arrays(got, numbered(bare, chosen[0], causes), names, 1 << 60) if causes is not None else local
        del got
        query = np.cumsum(starts(codes, ids)) - 1 if len(at) else at
        for first in range(0, int(query[-1]) + 1 if len(at) else 0, BLOCK):
            low, high = np.searchsorted(query, [first, first + BLOCK])
            q = query[low:high] - first
            own = np.flatnonzero(starts(q))
            found = beam(codes[low:high], q, local, later, width, names)
            if not sum(len(h["q"]) for h in found):
                continue
            out = answers_of(found, codes[low:high][own], top_k, vote_weight, branch_bonus, best_path, names)
            out["query_id"], out["seed"] = ids[low:high][own][out["q"]], codes[low:high][own][out["q"]]
            if causes is not None:
                out["reached"] = np.isin((out["q"] << 44) | out["entity"], reached_from(codes[low:high], q, every, causal))
            yield pa.RecordBatch.from_pydict({c: pa.array(out[c]).cast(types[kinds.get(c, "double")]) for c in written})

    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in written)
    part = lambda i: rows if n == 1 else rows.where(F.pmod(F.xxhash64("src"), F.lit(n)) == i)
    done = materialize_parts((part(i).repartition(tasks, "src").mapInArrow(work, schema) for i in range(n)), rows.sparkSession, "answers")
    for o in [*later, *causal]:
        drop(rows.sparkSession, o.path)
    rel = [names.relation_of(F.col(f"e{i}")) for i in range(1, hops + 1)]
    made = {"rels": F.array_compact(F.array(*rel)), "path": F.array_compact(F.array(names.text(F.col("seed")), *[c for i, r in enumerate(rel, 1) for c in (r, F.when(F.col(f"n{i}") >= 0, names.text(F.col(f"n{i}"))))]))}
    return done.select("query_id", "rank", names.text(F.col("entity")).alias("entity"), *[made[c].alias(c) if c in made else F.col(c) for c in columns])
