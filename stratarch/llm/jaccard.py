"""N-gram Jaccard join by PartEnum signatures, exact; and near-duplicate groups from its pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, key_columns, materialize, maybe_broadcast
from .textbatch import U64, WORD, TextBatch, batches, distinct, grams, int64, mix, starts_of_runs

#: Second-level partitions of each first-level one; signatures enumerate its subsets of SUB - 1.
SUB = 3
#: Extra first-level partitions, in percent; they pay for signatures that may be left out.
SPARE = 30
#: Signatures that a pair must share to be a candidate; plan() sees to it that similar sets do.
SHARED = 3
#: Counters of how many sets hold an element, by its hash. Their number is fixed; they only rank signatures.
COUNTERS = 1 << 16
_C = U64(0x9E3779B97F4A7C15)


def bands(threshold: float, most: int) -> np.ndarray:
    """Lower ends of size bands: sets of similarity >= threshold are in the same band or in neighbouring ones."""
    low = [1]
    while low[-1] <= most:
        low.append(int(low[-1] / threshold + 1e-9) + 1)
    return np.array(low)


def plan(threshold: float, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per band: first-level partitions, and how many of its weakest signatures a set may leave out.

    Two sets of the band's join differ in at most k elements. A first-level partition with no difference shares SUB
    signatures, one with a single difference shares the one that leaves that cell out. With n partitions that makes
    at least 2 n - k shared signatures, however the differences fall. All sets rank equal signatures alike, so when
    each leaves out its 2 n - k - SHARED weakest, the SHARED strongest shared ones remain with both. Sets that may
    not differ at all have no signatures: equal ones are known by their hash.
    """
    high = np.floor(low / threshold + 1e-9)
    k = np.floor(2 * high * (1 - threshold) / (1 + threshold) + 1e-9).astype(np.int64)
    need = k // 2 + 1
    parts = np.maximum(need + need * SPARE // 100, (k + SHARED + 1) // 2)
    return np.where(k > 0, parts, 0), np.where(k > 0, 2 * parts - k - SHARED, 0)


class Sets:
    """Distinct n-grams of the words of lower-case texts, punctuation dropped."""

    def __init__(self, t: TextBatch, n: int):
        starts, ends = t.spans(WORD[t.buf])
        doc = t.doc_of(starts)
        h, gram_doc, at = grams(t.hashes(starts, ends), doc, n)
        keep = distinct(gram_doc, h)
        self.doc, self.element = gram_doc[keep], h[keep]
        self.size = np.bincount(self.doc, minlength=t.n)
        total = np.zeros(len(self.element) + 1, U64)
        np.cumsum(mix(self.element ^ _C), out=total[1:])
        border = np.append(0, np.cumsum(self.size))
        self.id = mix((total[border[1:]] - total[border[:-1]]) + self.size.astype(U64) * _C)


def counter(element: np.ndarray) -> np.ndarray:
    return (mix(element ^ _C) >> U64(48)).astype(np.int64)


def signatures(s: Sets, threshold: float, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, signature) for the band of each set and the next one up; the lowest bit tells which. Two sets need
    only meet where one of them is at home.

    A signature is as strong as its elements are rare, by `rarity` of their counters; weak ones, of few or common
    elements, are what unlike sets share by chance.
    """
    rare = rarity[counter(s.element)]
    low = bands(threshold, int(s.size.max(initial=1)))
    low = np.append(low, int(low[-1] / threshold) + 1)
    parts, leave = plan(threshold, low)
    own = np.searchsorted(low, s.size, "right") - 1
    out_doc, out_sig = [], []
    for up in (0, 1):
        band = own + up
        used = s.size > 0
        if up:  # only sets that may have a partner there
            used &= np.floor(s.size / threshold + 1e-9) >= low[band]
        cells = np.where(used, parts[np.maximum(band, 0)], 0)
        base = np.append(0, np.cumsum(cells))
        pick = used[s.doc]
        doc, element, weight = s.doc[pick], s.element[pick], rare[pick]
        some = cells[doc] > 0
        doc, element, weight = doc[some], element[some], weight[some]
        spread = mix(element + band[doc].astype(U64))
        group = base[doc] + ((spread >> U64(32)) % cells[doc].astype(U64)).astype(np.int64) if len(doc) else doc
        cell = group * SUB + (spread % U64(SUB)).astype(np.int64) if len(doc) else doc
        n = int(base[-1]) * SUB
        value = mix(element)
        half = [np.bincount(cell, weights=(v & U64(0xFFFFFFFF)).astype(np.float64), minlength=n).astype(np.int64).astype(U64) for v in (value, value >> U64(32))]
        sums = (half[0] + (half[1] << U64(32))).reshape(-1, SUB)
        strength = np.bincount(cell, weights=weight, minlength=n).reshape(-1, SUB)
        owner = np.repeat(np.arange(len(cells)), cells)
        place = np.arange(int(base[-1])) - np.repeat(base[:-1], cells)
        tag = mix(band[owner].astype(U64) * U64(1 << 40) + place.astype(U64) * U64(SUB))
        rest = sums.sum(1, dtype=U64)[:, None] - sums
        sig = (mix(rest + tag[:, None] + np.arange(SUB, dtype=U64)[None, :]).ravel() & ~U64(1)) | U64(up)
        strong = (strength.sum(1)[:, None] - strength).ravel()
        who = np.repeat(owner, SUB)
        # leave out the weakest of each set
        order = np.argsort((who.astype(U64) << U64(44)) | (np.minimum(strong, 4095).astype(U64) << U64(32)) | (sig >> U64(32)))
        first = np.append(0, np.cumsum(cells * SUB))
        rank = np.arange(len(order)) - np.repeat(first[:-1], cells * SUB)
        stays = order[rank >= leave[np.maximum(band, 0)][who[order]]]
        out_doc.append(who[stays])
        out_sig.append(sig[stays])
    return np.concatenate(out_doc), np.concatenate(out_sig)


#: Bins of a one-permutation minhash, and their size in bits of an element; two neighbouring bins make a band.
BINS, BIN_BITS = 16, 4


def band_keys(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """(keys, how many of them each text has): the least element of two neighbouring bins of the hash range each. Near
    copies share most; a band without elements has no key."""
    slot = s.doc * BINS + (s.element >> U64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(starts_of_runs(slot))  # elements of a text ascend
    least = np.zeros(len(s.size) * BINS, U64)
    least[slot[first]] = s.element[first]
    least = least.reshape(-1, BINS // 2, 2)
    key = mix(mix(least[:, :, 0] + np.arange(BINS // 2, dtype=U64)) + least[:, :, 1])
    some = least.any(2)
    return key[some], some.sum(1)


def _sets(n: int):
    """A row for each text, and behind a task's last one a row with its counters alone."""

    def run(it):
        counts = np.zeros(COUNTERS, np.int64)
        for part in batches(it):
            s = Sets(TextBatch(part["text"]), n)
            counts += np.bincount(counter(s.element), minlength=COUNTERS)
            keys, each = band_keys(s)
            bands = pa.ListArray.from_arrays(np.append(0, np.cumsum(each)).astype(np.int32), int64(keys))
            columns = [part["id"], part["did"], part["th"], int64(s.id), int64(s.size), pa.array(sketches(s), pa.binary()), bands, pa.nulls(len(s.size), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, _SET_NAMES)
            id_type = part["id"].type
        if counts.any():
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_type), none, none, none, none, pa.nulls(1, pa.binary()), pa.nulls(1, bands.type), pa.array([counts.tobytes()])], _SET_NAMES)

    return run


_SET_NAMES = ["id", "did", "th", "sid", "size", "sketch", "bands", "counts"]


def _counter_rows(it):
    total = np.zeros(COUNTERS, np.int64)
    for batch in it:
        for c in batch.column(0):
            total += np.frombuffer(c.as_buffer(), np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


def _rarity(rows: DataFrame) -> np.ndarray:
    """Sixteenths of a bit of information by counter; the driver gets COUNTERS rows at most."""
    summed = rows.where("counts is not null").select("counts").mapInArrow(_counter_rows, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    sets = max(1, rows.where("counts is null").count())
    out = np.full(COUNTERS, sets, np.float64)
    for r in summed.collect():
        out[r.at] = max(1.0, sets / r.n)
    return np.maximum(1, np.round(16 * np.log2(out))).astype(np.int64)


#: Marks the number of a class; less than it is the size of a set that has none.
CLASSED = 1 << 62


def _signature_rows(n: int, threshold: float, rarity: np.ndarray):
    def run(it):
        for part in batches(it):
            s = Sets(TextBatch(part["text"]), n)
            doc, sig = signatures(s, threshold, rarity)
            cls = part["cls"].to_numpy()
            cls = np.where(cls == 0, s.size, (cls & (CLASSED - 1)) | CLASSED)
            yield pa.RecordBatch.from_arrays([int64(sig), int64(s.id[doc]), pa.array(cls[doc])], ["sig", "sid", "cls"])

    return run


def _element_rows(n: int):
    def run(it):
        for part in batches(it):
            t = TextBatch(part["text"])
            s = Sets(t, n)
            offsets = np.append(0, np.cumsum(s.size)).astype(np.int32) * 8
            col = pa.Array.from_buffers(pa.binary(), t.n, [None, pa.py_buffer(offsets), pa.py_buffer(s.element.tobytes())])
            yield pa.RecordBatch.from_arrays([int64(s.id), col], ["sid", "elements"])

    return run


#: Pairs that _pairs_of_runs holds at a time.
HELD = 1 << 19


def _pairs_of_runs(threshold: float):
    """Rows sorted by (signature, cls, sid) to pairs of sids of unlike classes and how many of a batch's signatures they
    share; a batch's last run waits for the next.

    Sets of one class never pair here, so a group of near copies costs its rows, not its pairs; nor do sets that are
    both from the band below, which meet at home, or whose sizes are too unlike.
    """

    def given(a, b):
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(starts_of_runs(a) | starts_of_runs(b))
        c = np.diff(np.append(first, len(a))).astype(np.int32)
        for k in range(0, len(first), 1 << 16):
            at = first[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(c[k : k + (1 << 16)])], ["a", "b", "c"])

    def pairs(sig, sid, cls):
        new = starts_of_runs(sig >> 1)
        keep = new | starts_of_runs(sid)
        sig, sid, cls, new = sig[keep], sid[keep], cls[keep], new[keep]
        # every member pairs with those of its run that stand behind its own class
        run_end = _ends(np.flatnonzero(new), len(sig))
        own_end = _ends(np.flatnonzero(new | starts_of_runs(cls) | (cls < CLASSED)), len(sig))
        many = run_end - own_end
        some = np.flatnonzero(many)
        total = np.cumsum(many[some])
        at = 0
        while at < len(some):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + HELD, "right")))
            i, n = some[at:to], many[some[at:to]]
            j = np.repeat(own_end[i] - (np.cumsum(n) - n), n)
            i, j = np.repeat(i, n), j + np.arange(len(j))
            # by cls, sets without a class come first and ascend in size
            meet = ((sig[i] & sig[j] & 1) == 0) & ((cls[j] >= CLASSED) | (cls[i] >= threshold * cls[j] - 1e-9))
            if meet.any():
                yield from given(sid[i[meet]], sid[j[meet]])
            at = to

    def run(it):
        left = [np.zeros(0, np.int64)] * 3
        for batch in it:
            columns = [np.concatenate([old, batch.column(k).to_numpy()]) for k, old in enumerate(left)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0] >> 1, columns[0][-1] >> 1))
            left = [c[cut:] for c in columns]
            if cut:
                yield from pairs(*(c[:cut] for c in columns))
        if len(left[0]):
            yield from pairs(*left)

    return run


def _ends(first: np.ndarray, n: int) -> np.ndarray:
    """For each of n elements, where the run that it is in ends."""
    return np.repeat(np.append(first[1:], n), np.diff(np.append(first, n))) if n else first


def _verify(threshold: float):
    """Rows (members: [(sid, elements)], pairs: [(a, b)]) to pairs with their exact similarity."""

    def run(it):
        for batch in it:
            for members, pairs in zip(batch.column(0), batch.column(1)):
                m, p = members.values, pairs.values
                ids = m.field(0).to_numpy()
                raw = m.field(1)
                index = {int(x): k for k, x in enumerate(ids)}
                sets = [np.frombuffer(x.as_buffer(), U64) for x in raw]
                a = [index[x] for x in p.field(0).to_pylist()]
                b = [index[x] for x in p.field(1).to_pylist()]
                keep, value = [], []
                for k, (i, j) in enumerate(zip(a, b)):
                    x, y = sets[i], sets[j]
                    if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
                        continue
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    jaccard = common / (len(both) - common)
                    if jaccard >= threshold - 1e-12:
                        keep.append(k)
                        value.append(jaccard)
                if keep:
                    yield pa.RecordBatch.from_arrays([p.field(0).take(pa.array(keep)), p.field(1).take(pa.array(keep)), pa.array(value)], ["a", "b", "jaccard"])

    return run


def sketches(s: Sets) -> list[bytes]:
    """Parity of the elements in each of m cells, m the power of two (64 at least) in (size, 2 size]. Two sets' sketches
    differ in no more cells than the sets do in elements; a sketch folds to half its cells by XOR of its halves."""
    words = np.maximum(1, np.left_shift(1, np.ceil(np.log2(np.maximum(s.size, 1) + 1)).astype(np.int64)) // 64)
    base = np.append(0, np.cumsum(words))
    bit = mix(s.element + _C) & (words[s.doc] * 64 - 1).astype(U64)
    cell = base[s.doc] * 64 + bit.astype(np.int64)
    odd = (np.bincount(cell, minlength=int(base[-1]) * 64) & 1).astype(np.uint8)
    data = np.packbits(odd, bitorder="little").tobytes()
    return [data[x * 8 : y * 8] for x, y in zip(base.tolist(), base[1:].tolist())]


def _far_apart(threshold: float):
    """Rows (members: [(sid, size, sketch)], pairs: [(a, b)]) to the pairs that sizes and sketches don't rule out."""

    def run(it):
        for batch in it:
            for members, pairs in zip(batch.column(0), batch.column(1)):
                m, p = members.values, pairs.values
                order = np.argsort(m.field(0).to_numpy())
                ids, size = m.field(0).to_numpy()[order], m.field(1).to_numpy()[order]
                raw = [np.frombuffer(x.as_buffer(), U64) for x in m.field(2)]
                raw = [raw[k] for k in order.tolist()]
                cells = np.array([len(x) for x in raw])
                a, b = (np.searchsorted(ids, p.field(k).to_numpy()) for k in (0, 1))
                most = np.floor((1 - threshold) / (1 + threshold) * (size[a] + size[b]) + 1e-9)
                near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                width = np.minimum(cells[a], cells[b])
                for c in np.unique(width[near]):
                    some = np.flatnonzero((cells == c) | (cells == 2 * c))
                    place = np.zeros(len(cells), np.int64)
                    place[some] = np.arange(len(some))
                    table = np.stack([raw[k] if cells[k] == c else raw[k][:c] ^ raw[k][c:] for k in some])
                    at = np.flatnonzero(near & (width == c))
                    for block in np.array_split(at, max(1, len(at) * int(c) >> 20)):
                        gap = np.bitwise_count(table[place[a[block]]] ^ table[place[b[block]]]).sum(1, dtype=np.int64)
                        near[block] = gap <= most[block]
                if near.any():
                    which = pa.array(near)
                    yield pa.RecordBatch.from_arrays([p.field(0).filter(which), p.field(1).filter(which)], ["a", "b"])

    return run


#: Members of one verification task; a larger cluster is split into blocks of pairs between so many.
BLOCK = 2048


def _meet(candidates: DataFrame, sets: DataFrame, parts: list[str], check, schema: str, name: str) -> DataFrame:
    """Apply `check` to candidates (a, b) and what `sets` (sid, then `parts`) says of their members.

    A cluster's sets meet in one place, named by the least partner; there each set is sent once.
    """
    spark = candidates.sparkSession
    home = candidates.groupBy("a").agg(F.min("b").alias("x"))
    lead = candidates.groupBy(F.col("b").alias("s")).agg(F.min("a").alias("m")).unionByName(home.select(F.col("a").alias("s"), F.col("a").alias("m")))
    lead = lead.groupBy("s").agg(F.min("m").alias("m"))
    pairs = candidates.join(lead, candidates.a == lead.s).select(F.col("m").alias("g"), "a", "b")
    crowd = pairs.groupBy("g").agg(F.count("*").alias("c"))
    # pairs in a group of s sets number at most s * s / 2; blocks by hash keep a task's sets bounded
    blocks = F.greatest(F.ceil(F.sqrt(F.col("c") * 2.0) / BLOCK), F.lit(1))
    pairs = pairs.join(crowd, "g").withColumn("k", blocks).select(
        "g", F.pmod(F.xxhash64("a"), F.col("k")).alias("i"), F.pmod(F.xxhash64("b"), F.col("k")).alias("j"), "a", "b")
    pairs, path = materialize(pairs, "pairs")
    members = pairs.select("g", "i", "j", F.col("a").alias("sid")).unionByName(pairs.select("g", "i", "j", F.col("b").alias("sid"))).distinct()
    gathered = members.join(sets, "sid").groupBy("g", "i", "j").agg(F.collect_list(F.struct("sid", *parts)).alias("members"))
    asked = pairs.groupBy("g", "i", "j").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    out, _ = materialize(gathered.join(asked, ["g", "i", "j"]).select("members", "pairs").mapInArrow(check, schema), name)
    drop_path(spark, path)
    return out


#: Sets form a class up to this share of the threshold: groups that are nearly similar also cost no pairs outside it.
LOOSE = 0.75
#: Elements (columns) of a block that are multiplied at a time.
COLUMNS = 4096


def common_elements(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each of b; elements that only one side has cost nothing."""
    sets = [*a, *b]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    element = np.concatenate(sets) if len(owner) else np.zeros(0, U64)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    left = np.append(0, np.cumsum(owner < len(a)))
    first = np.flatnonzero(starts_of_runs(element))
    end = np.append(first[1:], len(element))
    both = (left[end] > left[first]) & (left[end] - left[first] < end - first)
    first, end = first[both], end[both]
    total = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(first), COLUMNS):
        f, e = first[k : k + COLUMNS], end[k : k + COLUMNS]
        column = np.repeat(np.arange(len(f)), e - f)
        own = owner[np.arange(len(column)) + np.repeat(f - (np.cumsum(e - f) - (e - f)), e - f)]
        x, y = np.zeros((len(a), len(f)), np.float32), np.zeros((len(b), len(f)), np.float32)
        is_a = own < len(a)
        x[own[is_a], column[is_a]] = 1
        y[own[~is_a] - len(a), column[~is_a]] = 1
        total += x @ y.T
    return total.astype(np.int64)


def _within_classes(threshold: float):
    """Rows (i, j, members: [(sid, w, side, elements)]) of a block of a class to (sid, root, n): a similar set of the
    block that stands for those connected within it, and the weight of all similar ones. In a block with i = j all
    members meet, else those of side 0 meet those of side 1."""

    def run(it):
        for batch in it:
            for i, j, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                m = members.values
                sid, w, side = (m.field(k).to_numpy() for k in (0, 1, 2))
                sets = [np.frombuffer(x.as_buffer(), U64) for x in m.field(3)]
                size = np.array([len(x) for x in sets])
                p = np.flatnonzero(side == 0)
                q = p if i == j else np.flatnonzero(side == 1)
                if not len(p) or not len(q):
                    continue
                common = common_elements([sets[k] for k in p], [sets[k] for k in q])
                similar = common >= (threshold - 1e-12) * (size[p][:, None] + size[q][None, :] - common)
                if i == j:
                    np.fill_diagonal(similar, False)
                count = np.zeros(len(sid), np.int64)
                count[p] += similar @ w[q]
                if i != j:
                    count[q] += similar.T @ w[p]
                root = np.arange(len(sid))
                while True:  # the least member is passed on along similar pairs
                    new = root.copy()
                    new[p] = np.minimum(new[p], np.where(similar, new[q][None, :], len(sid)).min(1))
                    new[q] = np.minimum(new[q], np.where(similar, new[p][:, None], len(sid)).min(0))
                    if (new == root).all():
                        break
                    root = new
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(sid[root]), pa.array(count)], ["sid", "root", "n"])

    return run


class Similar:
    """The n-gram sets of docs and which are similar, exactly, as tables.

    `rows` (id, did, th, sid, size): the set of every row, named by a 64-bit hash of its elements. `sets` (sid, size,
    w): every distinct set that isn't empty, held by w rows. `blocks` (sid, root, n): sets of a class, each once for every
    block that it meets, with the weight n of similar ones there. `pairs` (a, b, jaccard): similar sets of unlike classes.

    Sets that agree in two minhash bands and in their sketches form classes. Within a class all sets meet, block by block, and no pair
    leaves its task. Sets of unlike classes are candidates when they share SHARED signatures, which all similar ones do;
    sizes and sketches, a few bits an element, rule out nearly all false candidates. All three checks are exact.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float):
        spark = docs.sparkSession
        text = F.lower(F.col(f"`{text_col}`").cast("string")).alias("text")
        keyed = docs.select(F.col(f"`{id_col}`").alias("id"), *key_columns(id_col, text_col, docs), text)
        id_type = docs.schema[id_col].dataType.simpleString()
        rows, _ = materialize(
            keyed.mapInArrow(_sets(n), f"id {id_type}, did long, th long, sid long, size long, sketch binary, bands array<long>, counts binary"), "sets")
        rarity = _rarity(rows)
        rows = rows.where("counts is null").drop("counts")
        known = rows.where("size > 0").groupBy("sid").agg(
            F.first("size").alias("size"), F.count("*").alias("w"), F.min(F.struct("did", "th")).alias("k"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
        known, _ = materialize(known, "known")
        self.rows, self.sets = rows.drop("sketch", "bands"), known.select("sid", "size", "w")
        # classes
        banded = known.select("sid", F.explode("bands").alias("band"))
        first = banded.groupBy("band").agg(F.min("sid").alias("a"), F.count("*").alias("c")).where("c > 1")
        stars = banded.join(first, "band").where("a != sid").groupBy("a", F.col("sid").alias("b")).agg(F.count("*").alias("c")).where("c > 1").select("a", "b")
        stars, stars_path = materialize(stars, "stars")
        sketched = known.select("sid", "size", "sketch")
        edges = _meet(stars, sketched, ["size", "sketch"], _far_apart(LOOSE * threshold), "a long, b long", "edges")
        drop_path(spark, stars_path)
        classes, _ = materialize(components(edges).select(F.col("node").alias("sid"), F.col("root").alias("cls")), "classes")
        # candidates of unlike classes
        classed = rows.join(classes, "sid").select("did", "th", "cls").distinct()
        classed, classed_path = materialize(classed, "classed")
        told = keyed.join(maybe_broadcast(classed, 40), ["did", "th"], "left").select("text", F.coalesce("cls", F.lit(0)).alias("cls"))
        sigs = told.mapInArrow(_signature_rows(n, threshold, rarity), "sig long, sid long, cls long")
        key = F.shiftright("sig", 1)
        found = sigs.repartition(key).sortWithinPartitions(key, "cls", "sid").mapInArrow(_pairs_of_runs(threshold), "a long, b long, c int")
        often = found.groupBy("a", "b").agg(F.sum("c").alias("c")).where(F.col("c") >= SHARED).select("a", "b")
        candidates, path = materialize(often, "candidates")
        drop_path(spark, classed_path)
        across = _meet(candidates, sketched, ["size", "sketch"], _far_apart(threshold), "a long, b long", "near")
        drop_path(spark, path)
        # the sets themselves, of all that may be similar to another
        wanted = across.select(F.col("a").alias("sid")).unionByName(across.select(F.col("b").alias("sid"))).unionByName(classes.select("sid")).distinct()
        stands, stands_path = materialize(known.join(wanted, "sid").select("k.did", "k.th").distinct(), "stands")
        elements = keyed.join(maybe_broadcast(stands, 32), ["did", "th"], "left_semi").select("text").mapInArrow(_element_rows(n), "sid long, elements binary")
        elements, elements_path = materialize(elements.groupBy("sid").agg(F.first("elements").alias("elements")), "elements")
        drop_path(spark, stands_path)
        self.pairs = _meet(across, elements, ["elements"], _verify(threshold), "a long, b long, jaccard double", "similar")
        self.blocks, _ = materialize(self._blocks(classes, elements, threshold), "blocks")
        drop_path(spark, elements_path)

    def _blocks(self, classes: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
        crowd = classes.groupBy("cls").agg(F.count("*").alias("c"))
        k = F.ceil(F.col("c") / BLOCK)
        placed = classes.join(crowd, "cls").join(self.sets.select("sid", "w"), "sid").select("cls", "sid", "w", k.alias("k"), F.pmod(F.xxhash64("sid"), k).alias("own"))
        # block (i, j), i <= j, of every set: as side 0 where its own number is i, as side 1 where it is j only
        sides = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other")).select(
            "cls", "sid", "w", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
        gathered = sides.join(elements, "sid").groupBy("cls", "i", "j").agg(F.collect_list(F.struct("sid", "w", "side", "elements")).alias("members"))
        return gathered.select("i", "j", "members").mapInArrow(_within_classes(threshold), "sid long, root long, n long")

    def edges(self) -> DataFrame:
        """(a, b): pairs of similar sets that connect the same sets as all such pairs."""
        return self.pairs.select("a", "b").unionByName(self.blocks.where("root != sid").select(F.col("root").alias("a"), F.col("sid").alias("b")))

    def links(self) -> DataFrame:
        """(sid, n): how many rows hold a similar set, another one than their own."""
        weight = self.sets.select("sid", "w")
        across = self.pairs.select(F.col("a").alias("to"), F.col("b").alias("sid")).unionByName(self.pairs.select(F.col("b").alias("to"), F.col("a").alias("sid")))
        across = across.join(weight, "sid").select(F.col("to").alias("sid"), F.col("w").alias("n"))
        return across.unionByName(self.blocks.select("sid", "n")).groupBy("sid").agg(F.sum("n").alias("n"))


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1, threshold: float = 0.8) -> DataFrame:
    """Which documents are near duplicates, by the Jaccard similarity of their n-gram sets.

    Result: (doc_id, class_id, links), one row for every row of docs. `links` is the number of other rows whose similarity
    is at least `threshold`; rows with equal sets, copies among them, count one by one. A class is what links connect;
    `class_id` is its least id (null only if all its ids are). Texts are put in lower case and cut into words of letters
    and digits; fewer than n words make one n-gram. The join is exact: no cap on partners or candidates, and no link
    between different texts is lost.

    Null, empty and wordless texts have no link and are a class of their own. Repeated rows link with each other. A
    null id stays null; ids may be of any type that has an order. Long texts count whole; an empty table gives no rows.
    """
    found = Similar(docs, id_col, text_col, n, threshold)
    roots = components(found.edges())
    # one row a set from here on; rows are joined with it at the end
    least = found.rows.where("size > 0").groupBy("sid").agg(F.min("id").alias("least"))
    sets = found.sets.join(least, "sid").join(found.links(), "sid", "left").join(roots, F.col("sid") == F.col("node"), "left")
    sets = sets.select("sid", "least", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("root", "sid").alias("root"))
    sets, _ = materialize(sets, "set_classes")
    classes = sets.groupBy("root").agg(F.min("least").alias("class_id"))
    sets = sets.join(classes, "root").select("sid", "class_id", "links")
    worded = found.rows.where("size > 0").join(sets, "sid").select(F.col("id").alias("doc_id"), "class_id", "links")
    return worded.unionByName(found.rows.where("size = 0").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")))


#: Up to so many edges (16 bytes each) the driver finds the components; beyond, rounds of jobs do.
DRIVER_EDGES = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that it is connected with.

    Edges are counted first. A few are connected on the driver; more alternate large-star and small-star rounds, each
    written to the shared folder, until nothing changes; the number of rounds follows the logarithm of the longest path.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = near.join(least, "a")
        if large:
            return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))

    def settled(e: DataFrame) -> tuple[DataFrame, str, tuple]:
        e, path = materialize(e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return e, path, tuple(mark)

    e, path, mark = settled(edges.select("a", "b"))
    if mark[0] <= DRIVER_EDGES:
        found = spark.createDataFrame(_least_connected(e.toArrow()), "node long, root long")
        drop_path(spark, path)
        return found
    while True:
        large, large_path, _ = settled(star(e, True))
        new, new_path, new_mark = settled(star(large, False))
        drop_path(spark, large_path)
        drop_path(spark, path)
        e, path = new, new_path
        if new_mark == mark:
            break
        mark = new_mark
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _least_connected(edges: pa.Table) -> pa.Table:
    a, b = edges.column("a").to_numpy(), edges.column("b").to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        new = new[new]
        if (new == root).all():
            return pa.table({"node": nodes, "root": nodes[root]})
        root = new


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each class of duplicate_classes: the one of least id (null first), then text hash.

    Ids that aren't integers are ordered by their hashes. Rows equal in id and text are one document, of which the row
    with the least hash of all columns (but maps) stays. Null, empty and wordless texts are in no class and all
    stay. Columns pass through whatever their names.

    Texts meet only a list of what goes.
    """
    found = Similar(docs, id_col, text_col, n, threshold)
    roots = components(found.edges())
    worded = found.rows.where("size > 0")
    sets = worded.groupBy("sid").agg(F.min(F.struct("did", "th")).alias("k")).join(roots, F.col("sid") == F.col("node"), "left").select("sid", "k", F.coalesce("root", "sid").alias("root"))
    sets, _ = materialize(sets, "set_roots")
    first = sets.groupBy("root").agg(F.min("k").alias("first"))
    stays, _ = materialize(sets.join(first, "root").select("sid", "first"), "firsts")
    counted = worded.groupBy("sid", "did", "th").agg(F.count("*").alias("c")).join(stays, "sid")
    gone = counted.where("first.did != did or first.th != th").select(F.col("did").alias("g_did"), F.col("th").alias("g_th")).distinct()
    gone, _ = materialize(gone, "gone")
    again, _ = materialize(counted.where("first.did = did and first.th = th and c > 1").select(F.col("did").alias("g_did"), F.col("th").alias("g_th")), "again")
    did, th = key_columns(id_col, text_col, docs)
    on = (did == F.col("g_did")) & (th == F.col("g_th"))
    kept = docs.join(maybe_broadcast(gone, 32), on, "left_anti")
    if again.isEmpty():
        return kept
    repeated = maybe_broadcast(again, 32)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not _has_map(f.dataType)]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(repeated, on, "left_semi").groupBy(did.alias("did"), th.alias("th")).agg(F.min_by(whole, F.xxhash64(*hashed)).alias("r")).select("r.*")
    return kept.join(repeated, on, "left_anti").unionByName(once)


def _has_map(kind) -> bool:
    return "map<" in kind.simpleString()
