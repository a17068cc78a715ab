"""N-gram Jaccard join with a token-group matrix.

Texts are sets of hashed word shingles; equal sets are one class, found by fingerprint. A class's prefix are
its first n - ceil(t n) + c tokens in a common order, tokens of many documents last. Of two classes that link,
at most n - ceil(t n) tokens of either are not common, so the first c common tokens stand in both prefixes:
they share c(m) prefix tokens, m the smaller set's size. c grows with the size, so that a shared passage or a
few stray tokens don't make a candidate. Only tokens that stand in two prefixes matter further.

Groups: each class is filed under the hub that it shares most prefix tokens with, and is tested against it; a
token's hub is its least class of about that size. What no hub took in gets another round. Linked classes form a group; classes that their hub didn't take in form
groups by hub. The matrix holds, per prefix token, the groups that have it. A class is sent to another group if
it has c prefix tokens in common with it, and to its own if that isn't one component. The token union of each
block of a group is stored; a class's overlap with it bounds that with every member, and only blocks whose bound
reaches the threshold are opened: only then are their members' sets read. Groups and the classes that are sent to
them are cut into blocks, so no task gathers a large group, and copies are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm._common import Words, given_back, mixed, ranged, slices_by_bytes
from textmill.shared import stored

SHINGLE = 5
PERCENT = 80
ROUNDS = 2
COMMON_IN_TASK = 3  # documents of a task from which on a token is reported as common
MAX_COMMON = 200_000  # common tokens that are put last in the order; any choice gives the same result
MOST_SEEN = 500_000  # entries of what a task remembers to spare work
BLOCK = 256  # classes of a group that are compared at once
SENT = 512  # classes that are sent to a block at once
BUCKET = 2000  # rows that a task of the comparison gets, about

_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its word shingles; fewer words than size are one shingle."""
    cut = Words(column, "space")
    words, rows = cut.digests()[:, 0][cut.number], cut.rows
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        total += words[k : k + len(total)] * _ODD[k]
    total = mixed(total)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(total[a : b - size + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            yield mixed(np.array([(words[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield words[:0]


def fingerprint(tokens: np.ndarray) -> int:
    """64 bits of a whole set; two different sets share one with a probability of 2**-64."""
    return int(mixed(tokens * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(tokens))).sum(dtype=np.uint64).astype(np.int64))


def need(n: np.ndarray | int, percent: int):
    """The least overlap that a set of n tokens needs with any set that it links with."""
    return (n * percent + 99) // 100


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A row's id and text in 64 bits."""
    return F.xxhash64(docs[id_col].cast("string"), docs[text_col].cast("string"))


def certain(n):
    """How many prefix tokens a set of n shares with any set of its size or more that it links with."""
    return n // 20 + 1


def _certain_links(n: Column, percent: int = PERCENT) -> Column:
    """The same for all sets that a set of n can link with: they have percent of its size at least."""
    return F.floor(F.ceil(n * percent / 100) / 20) + 1


def _by_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[text_col].cast("string").alias("text"), docs[id_col].alias("id"), _key(docs, id_col, text_col).alias("key"))


def _classes(rows: DataFrame, size: int) -> DataFrame:
    """Per row id, key, n and fp; and, in rows of their own with common set, tokens that a task has often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kind = pa.string()
        parts: list[np.ndarray] = []
        held = 0
        often: dict[int, int] = {}

        def counted() -> None:
            tokens, n = np.unique(np.concatenate(parts), return_counts=True)
            if len(often) > MOST_SEEN:  # rare ones go: any choice gives the same result
                for t in [t for t, c in often.items() if c < 2 * COMMON_IN_TASK]:
                    del often[t]
            for t, c in zip(tokens[n >= COMMON_IN_TASK].view(np.int64).tolist(), n[n >= COMMON_IN_TASK].tolist(), strict=True):
                often[t] = often.get(t, 0) + c

        for batch in batches:
            kind = batch.column(1).type
            for part in slices_by_bytes(batch, 0):
                if len(seen) > MOST_SEEN:
                    seen.clear()
                n, fps = [], []
                for tokens in shingle_sets(part.column(0), size):
                    fp = fingerprint(tokens)
                    n.append(len(tokens))
                    fps.append(fp)
                    if fp not in seen:
                        seen.add(fp)
                        parts.append(tokens)
                        held += len(tokens)
                if held > 4_000_000:
                    counted()
                    parts, held = [], 0
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), none, none], names=["id", "key", "n", "fp", "common", "times"])
        if parts:
            counted()
        given_back()
        if often:
            none = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(often), kind), none, none, none, pa.array(list(often), pa.int64()), pa.array(list(often.values()), pa.int64())], names=["id", "key", "n", "fp", "common", "times"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, n long, fp long, common long, times long")


def _prefixes(rows: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """Rows (token, fp, n) of all prefixes; tokens in common come last in the order."""
    box = rows.sparkSession.sparkContext.broadcast(np.sort(common))  # MAX_COMMON at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = box.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices_by_bytes(batch, 0):
                tokens, fps, sizes = [], [], []
                if len(seen) > MOST_SEEN:
                    seen.clear()
                for x in shingle_sets(part.column(0), size):
                    fp = fingerprint(x)
                    if not len(x) or fp in seen:
                        continue
                    seen.add(fp)
                    n = min(len(x), len(x) - need(len(x), percent) + certain(len(x)))
                    sizes.append(np.full(n, len(x), np.int32))
                    if len(last):
                        at = np.searchsorted(last, x)
                        at[at == len(last)] = 0
                        late = last[at] == x
                        x = np.concatenate([x[~late], x[late]])
                    tokens.append(x[:n])
                    fps.append(np.full(n, fp, np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(fps)), pa.array(np.concatenate(sizes))], names=["token", "fp", "n"])
        given_back()

    return rows.select("text").mapInArrow(run, "token long, fp long, n int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """Rows (token, fp, n) of tokens with two classes or more.

    Each partition is a sorted stream of which one row is held, however many classes a token has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row that the batches so far ended with
        alone = False  # and whether it is its token's only one so far
        for batch in batches:
            t, f, n = (batch.column(k).to_numpy() for k in range(3))
            if not len(t):
                continue
            if last is not None:
                t, f, n = (np.concatenate([[x], y]) for x, y in zip(last, (t, f, n), strict=True))
            new_token = np.concatenate([[True], t[1:] != t[:-1]])
            new = new_token.copy()
            new[1:] |= f[1:] != f[:-1]
            t, f, n, new_token = t[new], f[new], n[new], new_token[new]
            size = np.bincount(np.cumsum(new_token) - 1)
            several = np.repeat(size, size) > 1
            if last is not None:
                several[0] &= alone  # else it was given before
                if not alone:
                    several[1 : size[0]] = True
            if size[-1] == 1 and not (last is not None and len(size) == 1 and not alone):
                alone = True
            else:
                alone = False
            last = (t[-1], f[-1], n[-1])
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[several], k) for x, k in ((t, pa.int64()), (f, pa.int64()), (n, pa.int32()))], names=["token", "fp", "n"])

    return prefixes.repartition("token").sortWithinPartitions("token", "fp").mapInArrow(run, "token long, fp long, n int")


def _sets(rows: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """fp and tokens of the wanted classes, each from one of its rows."""
    picked = classes.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("key").alias("key")).select("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, 0):
                sets = list(shingle_sets(part.column(0), size))
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["fp", "tokens"])

    return rows.join(picked, "key", "left_semi").select("text").mapInArrow(run, "fp long, tokens binary").dropDuplicates(["fp"])


_BOTH = ("g", "q", "comp", "block", "send", "is_q")


def _cut(sent: DataFrame, members: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame, int]:
    """What is sent and the members, by keys, in blocks that meet; and into how many buckets to deal them."""
    counted = sent.groupBy(*keys).agg(F.ceil(F.count("*") / SENT).cast("int").alias("sends")).join(members.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")), keys)
    cuts = stored(counted, "cuts")
    left = sent.join(cuts, keys).withColumn("send", F.pmod(F.xxhash64("q"), "sends").cast("int"))
    if "block" not in keys:
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = members.join(cuts, keys).select(*(c for c in members.columns), *([] if "block" in keys else [F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block")]), "sends")
    total = cuts.agg(F.sum(F.col("sends") * F.col("blocks"))).first()[0] or 0
    return left, right, max(8, -(-2 * total // BUCKET), -(-left.count() // BUCKET))


def _dealt(both: DataFrame, n: int) -> DataFrame:
    return both.withColumn("bucket", F.pmod(F.xxhash64("g", F.col("block").cast("long"), F.col("send").cast("long")), F.lit(n)))


def _opened(sent: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (q, g, comp, block): the blocks of groups whose token union holds enough of a class that is sent to the group.

    sent: (q, g, comp) with q's component; members: (fp, g, comp). A block's union is stored, and only unions
    and what is sent meet here: the members' sets stay where they are.
    """
    left, right, n = _cut(sent, members, ["g"], BLOCK)
    right = right.join(sets, "fp")

    def united(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (g, block), own in pdf.groupby(["g", "block"], sort=False):
            union = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in own["tokens"]]))
            out.append((g, block, union.tobytes(), int(own["sends"].iloc[0])))
        return pd.DataFrame(out, columns=["g", "block", "tokens", "sends"])

    parts = F.pmod(F.xxhash64("g", F.col("block").cast("long")), F.lit(n))
    unions = stored(right.select("g", "block", "tokens", "sends").withColumn("part", parts).groupBy("part").applyInPandas(united, "g long, block int, tokens binary, sends int"), "unions")
    right = unions.select("g", F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("comp"), "block", F.explode(F.sequence(F.lit(0), F.col("sends") - 1)).alias("send"), F.lit(False).alias("is_q"), "tokens")
    left = left.withColumn("is_q", F.lit(True)).select(*_BOTH).join(sets.withColumnRenamed("fp", "q"), "q").select(*_BOTH, "tokens")

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (g, block, _), own in pdf.groupby(["g", "block", "send"], sort=False):
            is_q = own["is_q"].to_numpy(bool)
            if is_q.all() or not is_q.any():
                continue
            union = np.frombuffer(own["tokens"].to_numpy()[~is_q][0], np.uint64)
            for q, comp, tokens in own.loc[is_q, ["q", "comp", "tokens"]].itertuples(index=False):
                x = np.frombuffer(tokens, np.uint64)
                at = np.searchsorted(union, x)
                at[at == len(union)] = 0
                if (union[at] == x).sum() >= need(len(x), percent):
                    out.append((int(q), g, int(comp), block))
        return pd.DataFrame(out, columns=["q", "g", "comp", "block"])

    return _dealt(left.unionByName(right), n).groupBy("bucket").applyInPandas(bound, "q long, g long, comp long, block int")


def _links(sent: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of classes that are sent to blocks of groups, rows (q, fp), as many as join the components that link there.

    sent: (q, g, comp, block) with q's component; members: (fp, g, comp, block).
    """
    left, right, n = _cut(sent, members, ["g", "block"], BLOCK)
    left = left.withColumn("is_q", F.lit(True)).select(*_BOTH)
    right = right.select("g", F.col("fp").alias("q"), "comp", "block", F.explode(F.sequence(F.lit(0), F.col("sends") - 1)).alias("send"), F.lit(False).alias("is_q"))
    both = left.unionByName(right).join(sets.withColumnRenamed("fp", "q"), "q")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby(["g", "block", "send"], sort=False):
            is_q = own["is_q"].to_numpy(bool)
            if is_q.all() or not is_q.any():
                continue
            names, comps = own["q"].to_numpy(), own["comp"].to_numpy()
            tokens = [np.frombuffer(x, np.uint64) for x in own["tokens"]]
            inside = np.flatnonzero(~is_q)
            sizes = np.array([len(tokens[i]) for i in inside])
            pool = np.concatenate([tokens[i] for i in inside])
            order = np.argsort(pool, kind="stable")
            pool, owner = pool[order], np.repeat(np.arange(len(inside)), sizes)[order]
            comps, parent = np.unique(comps, return_inverse=True)[1], np.arange(len(comps))  # parent: of components that links here joined
            for i in np.flatnonzero(is_q):
                q = tokens[i]
                low, high = np.searchsorted(pool, q), np.searchsorted(pool, q, "right")
                if (high > low).sum() < need(len(q), percent):
                    continue
                common = np.bincount(ranged(owner, low, high - low), minlength=len(inside))
                linked = np.flatnonzero(100 * common >= percent * (len(q) + sizes - common))
                apart, first = np.unique(parent[comps[inside[linked]]], return_index=True)
                mine = parent[comps[i]]
                for other, j in zip(apart, first, strict=True):
                    if other != mine:
                        out.append((names[i], names[inside[linked[j]]]))
                        parent[parent == other] = mine
        return pd.DataFrame(out, columns=["q", "fp"]).astype("int64")

    return _dealt(both, n).groupBy("bucket").applyInPandas(compare, "q long, fp long")


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of edges (a, b): the least node of each component.

    Rounds of neighbour minimum and pointer jumping, each written to a shared folder, until nothing changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        better = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        nxt = stored(better.join(jump, "root").select("node", "old", F.least("root", "further").alias("root")), "roots")
        labels = nxt.select("node", "root")
        if nxt.where("root <> old").isEmpty():
            return labels


def _components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, n_shingles, component_id, its key, and the key of its component's first row (null if alone)."""
    rows = _by_row(docs, id_col, text_col)
    out = stored(_classes(rows, size), "classes")
    classes = out.where("n > 0").select("key", "fp")
    often = out.where("common is not null").groupBy("common").agg(F.sum("times").alias("times"))
    common = np.array([r["common"] for r in often.where("times >= 8").orderBy(F.desc("times"), "common").limit(MAX_COMMON).collect()], np.int64).view(np.uint64)
    shared = stored(_shared(_prefixes(rows, common, size, percent)), "shared")
    # What shares too few tokens with all others together links with none.
    play = shared.groupBy("fp", "n").agg(F.count("*").alias("k")).where(F.col("k") >= _certain_links(F.col("n"), percent)).select("fp")
    shared = stored(_shared(shared.join(play, "fp", "left_semi").select("token", "fp", "n")), "shared")
    sets = stored(_sets(rows, classes, shared.select("fp").distinct(), size), "sets")
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    filed = docs.sparkSession.createDataFrame([], "fp long, hub long, round int")
    active = shared
    about = F.floor(F.log("n") / np.log(100 / percent))
    for k in range(rounds):
        sized = active.withColumn("about", about)
        hubs = sized.groupBy("token", "about").agg(F.min("fp").alias("hub"))
        counts = sized.join(hubs, ["token", "about"]).where("hub <> fp").groupBy("fp", "n", "hub").agg(F.count("*").alias("k")).where(F.col("k") >= _certain_links(F.col("n"), percent))
        pairs = stored(counts.groupBy(F.col("fp").alias("q")).agg(F.max_by("hub", F.struct("k", "hub")).alias("g")).withColumn("comp", F.col("q")), "pairs")
        if pairs.isEmpty():
            break
        used = pairs.select("g").distinct()
        first = F.lit(0).alias("block")
        found = stored(_links(pairs.select("q", "g", "comp", first), used.select(F.col("g").alias("fp"), "g", F.col("g").alias("comp"), first), sets, percent).select(F.col("q").alias("a"), F.col("fp").alias("b")), "links")
        links = links.unionByName(found)
        filed = filed.unionByName(pairs.select(F.col("q").alias("fp"), F.col("g").alias("hub"), F.lit(k).alias("round")))
        if k + 1 < rounds:
            done = found.select("a").unionByName(used.select(F.col("g").alias("a"))).distinct().withColumnRenamed("a", "fp")
            active = stored(active.join(done, "fp", "left_anti"), "active")
    roots = connected_components(links)
    # The token-group matrix.
    hub = filed.groupBy("fp").agg(F.min_by("hub", "round").alias("hub"))
    grouped = shared.select("fp", "n").distinct().join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(hub, "fp", "left")
    grouped = stored(grouped.select("fp", "n", F.coalesce("root", "fp").alias("comp"), F.coalesce("root", F.xxhash64(F.coalesce("hub", "fp"), F.lit("apart"))).alias("g")), "groups")
    sizes = grouped.groupBy("g").agg(F.count("*").alias("m"), (F.min("comp") < F.max("comp")).alias("several"), F.min("n").alias("least"), F.max("n").alias("most"))
    sized = grouped.drop("n").join(sizes, "g")
    matrix = shared.select("token", "fp", F.col("n").alias("tokens")).join(sized, "fp")
    across = matrix.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("token")
    matrix = stored(matrix.join(across, "token", "left_semi"), "matrix")
    entries = matrix.select("token", F.col("g").alias("other"), F.col("m").alias("size"), F.col("least").alias("from"), F.col("most").alias("to")).distinct()
    smaller = (F.col("m") < F.col("size")) | ((F.col("m") == F.col("size")) & (F.col("g") < F.col("other")))
    # Prefix tokens that a class has in common with a group's: at least those in common with the member that it links with.
    fits = (F.col("to") * 100 >= F.col("tokens") * percent) & (F.col("from") * percent <= F.col("tokens") * 100)
    pairs = matrix.join(entries, "token").where(smaller & fits).groupBy(F.col("fp").alias("q"), "tokens", "comp", F.col("other").alias("g")).agg(F.count("*").alias("k"))
    pairs = pairs.where(F.col("k") >= _certain_links(F.col("tokens"), percent)).select("q", "g", "comp")
    sent = stored(pairs.unionByName(sized.where("several").select(F.col("fp").alias("q"), "g", "comp")), "sent")
    if not sent.isEmpty():
        members = grouped.join(sent.select("g").distinct(), "g", "left_semi").select("fp", "g", "comp")
        opened = stored(_opened(sent, members, sets, percent), "opened")
        blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
        placed = members.join(members.groupBy("g").agg(blocks), "g").select("fp", "g", "comp", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"))
        placed = placed.join(opened.select("g", "block").distinct(), ["g", "block"], "left_semi")
        last = stored(_links(opened, placed, sets, percent).select(F.col("q").alias("a"), F.col("fp").alias("b")), "links")
        roots = connected_components(links.unionByName(last))
    ids = out.where("common is null").select("id", "n", "key", F.when(F.col("n") > 0, F.col("fp")).alias("fp"))
    ids = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("id", "n", "key", F.coalesce("root", "fp").alias("component"))
    several = ids.where("component is not null").groupBy("component").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("first_key"), F.count("*").alias("times")).where("times > 1").select("component", "least", "first_key")
    return ids.join(several, "component", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "key", "first_key")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id that links reach).

    Null, empty and blank texts have no shingles and link with nothing, so they keep their own id. Repeated
    rows and copies are one class with one component. Rows with a null id count as texts; if a component has
    no other id, its id is null. Other columns are not read. An empty table gives no rows.
    """
    return _components(docs, id_col, text_col, size, percent, rounds).select(id_col, "n_shingles", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs, all columns, of which one stays per component: that with the least id.

    Of rows that repeat an id and a text, one stays. Rows without shingles all stay.
    """
    found = stored(_components(docs, id_col, text_col, size, percent, rounds), "components")
    kept = found.where((F.col("n_shingles") == 0) | F.col("first_key").isNull() | (F.col("key") == F.col("first_key")))
    several = not kept.where("n_shingles > 0").groupBy("key").count().where("count > 1").isEmpty()
    kept = kept.select(F.col(id_col).alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    same = (_key(docs, id_col, text_col) == kept["kept_key"]) & docs[id_col].eqNullSafe(kept["kept_id"])
    out = docs.join(kept, same, "left_semi")
    if several:
        name = "key"
        while name in docs.columns:
            name += "_"
        blank = F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
        out = out.withColumn(name, _key(out, id_col, text_col))
        out = out.where(blank).unionByName(out.where(~blank).dropDuplicates([name])).drop(name)
    return out
