"""Source divergence audit: term shares of each source against its language, counted through a minimal acyclic transducer.

1. Terms (runs of letters and characters beyond ASCII, A-Z lower-cased) are counted by documents; each lang keeps the
   terms of at least `least_docs` of its documents. Tasks add up their own documents before anything is shuffled.
2. The kept terms are range-sorted by (lang, term). Every range builds minimal acyclic transducers from its sorted
   terms: states with equal futures are one, and each arc carries how many terms precede it, so walking a term yields
   its lexicographic ordinal. Transducers are rows of a written table, at most SHARD_TERMS terms each.
3. The texts are read again and streamed through the transducers, which counts kept terms by ordinal for every (lang,
   source). Transducers are taken in rounds of at most ROUND_BYTES, however large the vocabulary; a task holds one
   round and walks each distinct term of its documents once.
4. Blocks of ordinals are compared as (source x ordinal) matrices in exact 64-bit integers; ranks are top-k windows,
   with ordinals for ties, and ranked ordinals are spelled out by walking the transducer backwards.

Shares are p = 1 + floor(scale * (count + 1) / (N + V)), a divergence is floor((p - q)^2 / q). The division is done in
steps of a thousand, so counts up to 9e15 stay exact; sums stay below (scale + V)^2, within 64 bits for V up to 2e9.

Defined results: null text, lang and source are ''; a group without terms has p from counts of zero; a lang without
kept terms has pairs of value 0 and no term rows; a lang with one source has no pairs; repeated rows are documents of
their own, whatever their doc_id; texts and terms of any length are read whole; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eligrid.llm.common import shared_files, stored, worker_cache
from eligrid.session import broadcast_if_small

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
# Entries of a task's own counts before they leave; terms of one transducer; bytes of transducers in a task.
FLUSH = 200_000
PENDING = 1_000_000
SHARD_TERMS = 500_000
ROUND_BYTES = 64 << 20
# Cells of one (source x ordinal) matrix.
CELLS = 1 << 17
# Bits of a block's number within its lang.
BLOCK_BITS = 40
# Columns of a block's rows that are no ordinals.
TOTAL, TERMS = -1, -2

RESULT_ORDER = ("lang", "source", "part", "item", "value", "rank")
# Bytes of a text: capitals to small letters; all ASCII that is no letter separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return data.translate(LETTERS).split()


def _texts(docs: DataFrame) -> DataFrame:
    """Texts as their bytes, so that tasks need not decode and encode them."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).withColumn("text", F.col("text").cast("binary"))


def document_counts(docs: DataFrame, flush: int = FLUSH) -> DataFrame:
    """(lang, term, docs): partial numbers of documents that hold a term, added up within tasks."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        held, size = {}, 0

        def rows():
            for lang, found in held.items():
                for low in range(0, len(found), 50_000):
                    part = list(found.items())[low : low + 50_000]
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([lang] * len(part), pa.string()), "term": pa.array([t for t, _ in part], pa.binary()), "docs": pa.array([n for _, n in part], pa.int64())}
                    )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                found = held.setdefault(lang, Counter())
                size -= len(found)
                found.update(set(terms_of(text.as_py())))
                size += len(found)
                if size >= flush:
                    yield from rows()
                    size = 0
        yield from rows()

    return _texts(docs).select("lang", "text").mapInArrow(count, "lang string, term binary, docs long")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    return document_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term")


class Transducer:
    """Minimal acyclic transducer over bytes; arcs are arrays sorted by (state, byte).

    `before[a]` is how many accepted terms that share the prefix sort before those through arc a, so the sum along a
    term's path is its ordinal. Built from strictly increasing terms; a state whose last term is over is looked up by
    its outgoing arcs and shared with an equal one.
    """

    def __init__(self, keys, targets, before, final, size):
        self.keys, self.targets, self.before, self.final, self.size = keys, targets, before, final, size

    @classmethod
    def build(cls, terms):
        import numpy as np

        known, accepted, outgoing = {}, [], []

        def settle(node):
            # node: [final, arcs]; arcs: list of (byte, state id) of settled states.
            signature = (node[0], tuple(node[1]))
            at = known.get(signature)
            if at is None:
                at = known[signature] = len(accepted)
                accepted.append(node[0] + sum(accepted[target] for _, target in node[1]))
                outgoing.append(signature)
            return at

        path, letters, last, size = [[0, []]], [], None, 0
        for term in terms:
            if last is not None and term <= last:
                raise ValueError("terms must be strictly increasing")
            common = 0
            for common, (x, y) in enumerate(zip(letters, term)):
                if x != y:
                    break
            else:
                common = min(len(letters), len(term))
            while len(letters) > common:
                closed = settle(path.pop())
                path[-1][1].append((letters.pop(), closed))
            for byte in term[common:]:
                letters.append(byte)
                path.append([0, []])
            path[-1][0] = 1
            last, size = term, size + 1
        while letters:
            closed = settle(path.pop())
            path[-1][1].append((letters.pop(), closed))
        root = settle(path.pop())
        # The root comes first: state numbers are mirrored.
        count = len(outgoing)
        keys, targets, before = [], [], []
        for state in range(count):
            final, arcs = outgoing[root - state]
            passed = final
            for byte, target in arcs:
                keys.append(state << 8 | byte)
                targets.append(root - target)
                before.append(passed)
                passed += accepted[target]
        final = np.array([outgoing[root - s][0] for s in range(count)], bool)
        return cls(np.array(keys, np.int64), np.array(targets, np.int64), np.array(before, np.int64), final, size)

    def ordinals(self, terms):
        """Ordinal of every term, -1 where the transducer does not accept it; all terms step together."""
        import numpy as np

        out = np.full(len(terms), -1, np.int64)
        if not len(self.keys):
            return np.where([t == b"" for t in terms], 0, -1) if self.final[0] else out
        letters = np.frombuffer(b"".join(terms), np.uint8)
        length = np.fromiter(map(len, terms), np.int64, len(terms))
        start = np.cumsum(length) - length
        live = np.arange(len(terms))
        state, total = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        place = 0
        while len(live):
            over = length[live] == place
            if over.any():
                done = over & self.final[state]
                out[live[done]] = total[done]
                live, state, total = live[~over], state[~over], total[~over]
                if not len(live):
                    break
            wanted = state << 8 | letters[start[live] + place]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            good = self.keys[arc] == wanted
            live, arc = live[good], arc[good]
            state, total = self.targets[arc], total[good] + self.before[arc]
            place += 1
        return out

    def term(self, ordinal: int) -> bytes:
        """The accepted term with this ordinal."""
        import numpy as np

        state, letters = 0, []
        while True:
            if self.final[state] and ordinal == 0:
                return bytes(letters)
            low, high = np.searchsorted(self.keys, [state << 8, (state + 1) << 8])
            arc = low + int(np.searchsorted(self.before[low:high], ordinal, "right")) - 1
            ordinal -= int(self.before[arc])
            letters.append(int(self.keys[arc]) & 255)
            state = int(self.targets[arc])

    def to_bytes(self) -> bytes:
        import numpy as np

        head = np.array([len(self.keys), len(self.final), self.size], np.int64)
        return b"".join(x.tobytes() for x in (head, self.keys, self.targets, self.before, self.final))

    @classmethod
    def from_bytes(cls, data: bytes):
        import numpy as np

        arcs, states, size = np.frombuffer(data, np.int64, 3).tolist()
        cut = [np.frombuffer(data, np.int64, arcs, 24 + 8 * arcs * i) for i in range(3)]
        return cls(*cut, np.frombuffer(data, bool, states, 24 + 24 * arcs), size)


SHARD = "lang string, first binary, terms long, size long, machine binary"


def build_shards(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, first, terms, size, machine, base): transducers of sorted ranges; base: ordinal of a shard's first term."""
    kept = stored(kept, "kept-terms")
    ranges = max(1, -(-kept.count() // shard_terms))

    def build(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist())

        def shard(lang, terms):
            machine = Transducer.build(terms).to_bytes()
            return pa.RecordBatch.from_pylist([{"lang": lang, "first": terms[0], "terms": len(terms), "size": len(machine), "machine": machine}], schema)

        schema = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("terms", pa.int64()), ("size", pa.int64()), ("machine", pa.binary())])
        now, terms = None, []
        for lang, term in rows():
            if terms and (lang != now or len(terms) >= shard_terms):
                yield shard(now, terms)
                terms = []
            now = lang
            terms.append(term)
        if terms:
            yield shard(now, terms)

    ordered = kept.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")
    shards = stored(ordered.mapInArrow(build, SHARD), "transducers")
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    # One row per transducer, at least half a million terms each but for the ends of ranges.
    base = shards.select("lang", "first", "terms", "size", F.coalesce(F.sum("terms").over(before), F.lit(0)).alias("base"))
    running = Window.orderBy("lang", "first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rounds = base.withColumn("round", F.floor((F.sum("size").over(running) - F.col("size")) / F.lit(ROUND_BYTES)))
    # A lang's first term may be the empty string of bytes only if terms could be empty; they cannot.
    return stored(shards.drop("terms", "size").join(rounds, ["lang", "first"]), "transducer-rounds")


def _machines(folder: str, number: int):
    """lang -> sorted list of (first term, base, transducer) of one round, kept while this round runs in a worker."""

    def read():
        import pyarrow.dataset as ds

        files, path = shared_files(folder)
        table = ds.dataset(path, filesystem=files, format="parquet").to_table(filter=ds.field("round") == number)
        found = {}
        for row in table.to_pylist():
            found.setdefault(row["lang"], []).append((row["first"], row["base"], Transducer.from_bytes(row["machine"])))
        return {lang: sorted(shards, key=lambda s: s[0]) for lang, shards in found.items()}

    return worker_cache(("transducers", folder, number), read)


def _summed(keys, counts):
    """Distinct keys in order with the sums of their counts."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class _Recount:
    """Counts of one task: tokens by number, numbers to ordinals through the transducers, sums per (group, ordinal).

    A distinct term gets a number when it is first met and is walked once; the numbers start anew when `flush` terms
    are held, and sums leave when `pending` of them are held, so memory does not grow with the input.
    """

    def __init__(self, machines, flush, pending):
        self.machines, self.flush, self.pending = machines, flush, pending
        self.groups, self.tokens, self.waiting, self.sums, self.held = {}, [], 0, [], 0
        self.reset()

    def reset(self):
        from collections import defaultdict
        from itertools import count

        self.numbers = {}
        self.fresh = lambda: defaultdict(count().__next__)

    def add(self, lang, source, terms):
        import numpy as np

        group = self.groups.setdefault((lang, source), len(self.groups))
        if lang not in self.machines or not terms:
            return
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = self.fresh()
        self.tokens.append((lang, group, np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms))))
        self.waiting += len(terms)
        if self.waiting >= self.pending or sum(map(len, self.numbers.values())) >= self.flush:
            self.settle()

    def settle(self):
        """Numbers of the waiting tokens become sums per (group, ordinal)."""
        import numpy as np

        for lang, numbers in self.numbers.items():
            own = [(group, ids) for other, group, ids in self.tokens if other == lang]
            ordinal = self.ordinals(lang, list(numbers))
            keys = np.concatenate([np.zeros(0, np.int64)] + [np.where(ordinal[ids] >= 0, group << 40 | ordinal[ids], -1) for group, ids in own])
            keys = keys[keys >= 0]
            self.sums.append(_summed(keys, np.ones(len(keys), np.int64)))
            self.held += len(self.sums[-1][0])
        self.tokens, self.waiting = [], 0
        self.reset()
        if self.held >= self.pending:
            self.merge()

    def ordinals(self, lang, terms):
        from bisect import bisect_left

        import numpy as np

        order = sorted(range(len(terms)), key=terms.__getitem__)
        words = [terms[i] for i in order]
        out = np.full(len(terms), -1, np.int64)
        shards = self.machines[lang]
        cuts = [bisect_left(words, first) for first, _, _ in shards] + [len(words)]
        for (_, base, machine), low, high in zip(shards, cuts, cuts[1:]):
            if low < high:
                own = machine.ordinals(words[low:high])
                out[np.array(order[low:high])] = np.where(own >= 0, own + base, -1)
        return out

    def merge(self):
        import numpy as np

        if self.sums:
            self.sums = [_summed(np.concatenate([k for k, _ in self.sums]), np.concatenate([n for _, n in self.sums]))]
            self.held = len(self.sums[0][0])

    def leave(self):
        """Record batches of all sums; every group met so far comes once with no ordinals."""
        import numpy as np
        import pyarrow as pa

        self.merge()
        keys, counts = self.sums[0] if self.sums else (np.zeros(0, np.int64),) * 2
        names = list(self.groups)
        rows = [(*name, [], []) for name in names]
        bounds = np.searchsorted(keys, np.arange(len(names) + 1) << 40)
        for (lang, source), low, high in zip(names, bounds, bounds[1:]):
            for at in range(low, high, 50_000):
                part = slice(at, min(at + 50_000, high))
                rows.append((lang, source, keys[part] & ((1 << 40) - 1), counts[part]))
        for lang, source, ordinals, n in rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang], pa.string()),
                    pa.array([source], pa.string()),
                    pa.ListArray.from_arrays([0, len(ordinals)], pa.array(ordinals, pa.int64())),
                    pa.ListArray.from_arrays([0, len(n)], pa.array(n, pa.int64())),
                ],
                ["lang", "source", "ordinals", "counts"],
            )
        self.groups, self.sums, self.held = {}, [], 0


def recount(docs: DataFrame, folder: str, number: int, flush: int = FLUSH, pending: int = PENDING) -> DataFrame:
    """(lang, source, ordinal, n): kept terms of one round; rows with ordinal -1 name every group."""

    def stream(batches):
        state = _Recount(_machines(folder, number), flush, pending)
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                state.add(lang, source, terms_of(text.as_py()))
                if state.held >= pending or len(state.groups) >= flush:
                    state.settle()
                    yield from state.leave()
        state.settle()
        yield from state.leave()

    packed = _texts(docs).mapInArrow(stream, "lang string, source string, ordinals array<long>, counts array<long>")
    group = F.array(F.struct(F.lit(-1).cast("long").alias("ordinals"), F.lit(0).cast("long").alias("counts")))
    pairs = F.when(F.size("ordinals") > 0, F.arrays_zip("ordinals", "counts")).otherwise(group)
    return packed.select("lang", "source", F.explode(pairs).alias("x")).select("lang", "source", F.col("x.ordinals").alias("ordinal"), F.col("x.counts").alias("n"))


def shares(counts, total, terms, scale: int = SCALE):
    """1 + floor(scale * (count + 1) / (total + terms)) in exact 64-bit steps; scale is a power of a thousand."""
    import numpy as np

    whole = np.asarray(total, np.int64) + terms
    above = np.asarray(counts, np.int64) + 1
    value, rest = above // whole, above % whole
    while scale > 1:
        rest = rest * 1000
        value = value * 1000 + rest // whole
        rest = rest % whole
        scale //= 1000
    return value + 1


BLOCK_ROW = "number long, source int, other int, ordinal long, value long"


def compare_blocks(counts: DataFrame, facts: DataFrame, cells: int = CELLS, top: int = TOP) -> DataFrame:
    """(lang, source, other, ordinal, value): pair sums of each block (ordinal -1), and its best terms (other -1).

    counts: lang, source, ordinal, n (n > 0); facts: lang, terms, sources (sorted array of source, total).
    """
    width = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.size("sources")))
    # Langs with terms are numbered, so that a block has one number for a key: rows are sorted by it without comparing names.
    known = facts.filter("terms > 0").select(
        "lang", F.row_number().over(Window.orderBy("lang")).cast("long").alias("number"), "terms", width.alias("width"),
        F.transform("sources", lambda s: s["total"]).alias("totals"), "sources",
    )
    places = known.select("lang", "number", "width", F.posexplode("sources").alias("row", "s")).select("lang", "number", "width", "row", F.col("s.source").alias("source"))
    block = F.floor(F.col("ordinal") / F.col("width"))
    cell = lambda at: F.shiftleft("number", BLOCK_BITS) + at
    placed = counts.join(broadcast_if_small(places), ["lang", "source"]).select(
        cell(block).alias("cell"), (F.col("ordinal") - block * F.col("width")).cast("int").alias("column"), "row", "n"
    )
    # Each block gets the number of terms and the totals of all sources as rows of negative columns. A nested column
    # here would cost time with the square of a batch: its size is taken anew with every row.
    last = F.floor((F.col("terms") - 1) / F.col("width"))
    totals = F.transform("totals", lambda n, i: F.struct(F.lit(TOTAL).alias("column"), i.alias("row"), n.alias("n")))
    terms = F.array(F.struct(F.lit(TERMS).alias("column"), F.lit(0).alias("row"), F.col("terms").alias("n")))
    heads = known.select(F.explode(F.sequence(cell(F.lit(0)), cell(last))).alias("cell"), F.concat(terms, totals).alias("facts")).select("cell", F.inline("facts"))
    rows = placed.unionByName(heads)

    def compare(key, table):
        import numpy as np
        import pyarrow as pa

        number, block = key[0].as_py() >> BLOCK_BITS, key[0].as_py() & ((1 << BLOCK_BITS) - 1)
        column, row, counted = (table.column(c).to_numpy() for c in ("column", "row", "n"))
        terms = int(counted[column == TERMS][0])
        totals = np.zeros((column == TOTAL).sum(), np.int64)
        totals[row[column == TOTAL]] = counted[column == TOTAL]
        width = max(1, cells // len(totals))
        held = column >= 0
        start = block * width
        columns = min(width, terms - start)
        n = np.zeros((len(totals), columns), np.int64)
        n[row[held], column[held]] = counted[held]
        p = shares(n, totals[:, None], terms)
        q = shares(n.sum(axis=0) if len(totals) else 0, totals.sum(), terms)
        out = {"source": [], "other": [], "ordinal": [], "value": []}

        def add(source, other, ordinal, value):
            for name, column in zip(out, np.broadcast_arrays(source, other, ordinal, value)):
                out[name].append(column.astype(np.int64))

        every = np.arange(len(totals))
        for s in every:
            gap = p[s] - p
            sums = (gap * gap // p).sum(axis=1)
            others = every[every != s]
            add(s, others, -1, sums[others])
            rising = np.flatnonzero((n[s] > 0) & (p[s] > q))
            value = (p[s] - q)[rising] ** 2 // q[rising]
            best = np.lexsort((rising, -value))[:top]
            add(s, -1, start + rising[best], value[best])
        made = {k: np.concatenate([np.atleast_1d(x) for x in v]) for k, v in out.items()}
        return pa.table(
            {
                "number": pa.array([number] * len(made["value"]), pa.int64()),
                "source": pa.array(made["source"], pa.int32()),
                "other": pa.array(made["other"], pa.int32()),
                "ordinal": pa.array(made["ordinal"], pa.int64()),
                "value": pa.array(made["value"], pa.int64()),
            }
        )

    found = rows.groupBy("cell").applyInArrow(compare, BLOCK_ROW)
    return found.join(broadcast_if_small(known.select("number", "lang")), "number").select("lang", "source", "other", "ordinal", "value")


def spelled(ranked: DataFrame, folder: str, number: int) -> DataFrame:
    """The rows of ranked whose ordinal belongs to a transducer of this round, with the term as item."""
    columns = ranked.columns

    def spell(batches):
        from bisect import bisect_right

        import pyarrow as pa

        machines = _machines(folder, number)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                shards = machines.get(row["lang"], [])
                by_base = sorted((base, i) for i, (_, base, _) in enumerate(shards))
                at = bisect_right(by_base, (row["ordinal"], len(shards))) - 1
                if at >= 0:
                    _, base, machine = shards[by_base[at][1]]
                    if row["ordinal"] - base < machine.size:
                        rows.append({**row, "item": machine.term(row["ordinal"] - base).decode("utf-8", "surrogatepass")})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*batch.schema, ("item", pa.string())]))

    kinds = ", ".join(f"{name} {kind}" for name, kind in ranked.dtypes)
    return ranked.select(*columns).mapInArrow(spell, f"{kinds}, item string")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank; see the contract of the query."""
    spark = docs.sparkSession
    shards = build_shards(kept_terms(docs, least_docs))
    folder = shards.inputFiles()[0].rsplit("/", 1)[0] if shards.inputFiles() else None
    rounds = [r[0] for r in shards.select("round").distinct().collect()]
    if not rounds:
        # No term is kept anywhere: every group still has its pairs.
        groups = _texts(docs).select("lang", "source").distinct().withColumn("ordinal", F.lit(-1).cast("long")).withColumn("n", F.lit(0).cast("long"))
        counted = stored(groups, "term-counts")
    else:
        each = [recount(docs, folder, r) for r in sorted(rounds)]
        union = each[0]
        for more in each[1:]:
            union = union.unionByName(more)
        counted = stored(union.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "term-counts")
    sizes = shards.groupBy("lang").agg(F.sum("terms").alias("terms"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = stored(
        totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources")).join(sizes, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0))),
        "source-facts",
    )
    values = stored(compare_blocks(counted.filter("ordinal >= 0"), facts, top=top), "block-values")
    named = facts.select("lang", F.posexplode("sources").alias("place", "s")).select("lang", "place", F.col("s.source").alias("source"))
    named = broadcast_if_small(named, written=True)
    sums = values.filter("ordinal < 0").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    a = named.select("lang", F.col("place").alias("source"), F.col("source").alias("source_name"))
    b = named.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    # Every pair is a row of the result, so this equi-join makes no more than that.
    pairs = a.join(b, "lang").filter("source <> other").join(sums, ["lang", "source", "other"], "left").select(
        "lang", F.col("source_name").alias("source"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )
    by_item = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = pairs.withColumn("rank", F.row_number().over(by_item)).withColumn("part", F.lit("pair"))
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = values.filter("ordinal >= 0").withColumn("rank", F.row_number().over(by_ordinal)).filter(F.col("rank") <= top)
    ranked = stored(best.join(a, ["lang", "source"]).select("lang", F.col("source_name").alias("source"), "ordinal", "value", "rank"), "ranked-terms")
    result = pair_rows.select(*RESULT_ORDER)
    for number in sorted(rounds):
        result = result.unionByName(spelled(ranked, folder, number).withColumn("part", F.lit("term")).select(*RESULT_ORDER))
    return result
