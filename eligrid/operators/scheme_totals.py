"""Totals per scheme and status over all profiles, without a row per pair.

A scheme sees of a profile only the results of its own few predicates and whether their fields are filled. How often
each combination of these occurs is all that its totals need, and schemes that read the same fields get it from one
histogram, so profiles are counted once per group of schemes and not once per scheme:

* Predicates lie on axes: the thresholds of a field on one, a few others of a field on another. A profile is written
  once, as one code per axis; a threshold axis has the profile's place among all thresholds.
* Tasks own ranges of schemes in the order of the axes that they read. Lists of rules are packed into groups as long as
  a histogram over all their axes, with the cuts that their predicates make, stays small. Profiles come block by block.
* The counts of a list of rules are sums over its group's histogram, and its combinations are decided once each, by the
  same fold as pairs (`predicate_index.folded`). Every pair is counted; none is ever a row.
* A scheme has one list of rules for most states and a further one for each state with rules of its own for it; the
  rule base is not repeated per state. The state of a profile is an axis like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.operators import decision, predicate_index, rulebase
from eligrid.session import broadcast_if_small, shared_file, written_table

# Schemes of one task at most, on average.
TASK_SCHEMES = 8192
# Predicates at most; a profile's axes hold the results of them all.
PREDICATES = 1 << 16
# Codes of one (profile x axis) block in a task.
BLOCK_CELLS = 1 << 24
# Cells of one histogram; a list of rules with more combinations than that has each block's decided at once.
COMBINATIONS = 1 << 18
# Cells of all histograms that a task holds at a time; for further ones it reads the profiles again.
HELD_CELLS = 1 << 25
# Results times filled or not.
CLASSES = 6
# Predicates that are no thresholds, each an expression of its own; more of them are evaluated over a table of them.
EXPRESSIONS = 256
# Predicates of one axis that are no thresholds: their results, three values each, fill a byte with the filled flag.
AXIS_OTHERS = 4
# Profiles whose joint code is made at a time.
STEP = 1 << 16
# Codes of several axes that a block's profiles hold as one.
PACKED = 1 << 12
# (combination x rule) cells that are decided at a time.
DECIDED_CELLS = 1 << 19

COUNTERS = ("c_pass", "c_fail", "rules_passed", "rules_failed", "rules_undetermined")
STATUSES = tuple(model.STATUS_BUCKETS)
TOTALS = "scheme_id string, status string, n long, " + "".join(f"{c} long, " for c in COUNTERS) + "low double, high double"
RULE = ("rule_id", "phase", "ord", "field", "slot", "operator", "v", "value_min", "value_max", "items", "pattern_ok", "audit_status", "audit_cents", "numeric_op")
NOTES = ("own_critical", "critical_notes", "high_notes", "medium_notes")
# What the fold reads of a rule, beside its predicate's result.
FLAGS, NUMBERS = ("numeric", "pending", "own_critical", "critical"), ("ord", "audit_cents", "penalty")
SLIM = ("phase", *FLAGS, *NUMBERS)


def totals(profile_cells: DataFrame, schemes: DataFrame, bound: DataFrame) -> DataFrame | None:
    """scheme_id, status, n, sums of the counters, lowest and highest composite; None where predicates are too many."""
    ready = prepared(profile_cells, schemes, bound)
    if ready is None:
        return None
    rows, held = ready
    cells, combinations = BLOCK_CELLS, COMBINATIONS

    def run(batches):
        yield from _counted(batches, held.value, cells, combinations)

    return rows.mapInArrow(run, TOTALS)


def prepared(profile_cells: DataFrame, schemes: DataFrame, bound: DataFrame):
    """(active schemes with their lists of rules, dealt to tasks by the axes that they read; the broadcast that tasks need with them)."""
    spark = profile_cells.sparkSession
    entries = bound.select("scheme_id", "rule_id", "state_scope", "supersedes_rule_id", F.struct(*RULE, *NOTES).alias("r"))
    entries = written_table(predicate_index.keyed(entries), "rules")
    numbered = predicate_index.number(entries)
    if numbered.count() > PREDICATES:
        return None
    found = predicate_index.predicates_of(numbered)
    names = (rulebase.NO_STATE, *model.STATE_CODES)
    states = spark.createDataFrame([(s,) for s in names], "state string")
    index = predicate_index.Index(found.others, found.ops, None, states)
    axes = _axes(numbered.select("key", "pid", "slot", "field").orderBy("pid").toPandas(), found, names)
    placed = decision.placed(profile_cells, states)
    results = predicate_index.unrolled_results(index) if len(found.other_pids) <= EXPRESSIONS else None
    profiles, seen = _written_codes(predicate_index.narrow(placed, index, results=results).drop("profile_id"), axes)
    keys = _ranked(axes, seen)
    held = spark.sparkContext.broadcast({**axes, "files": sorted(profiles.inputFiles()), "profiles": profiles.agg(F.sum("n")).first()[0] or 0})
    pids = broadcast_if_small(spark.createDataFrame(keys, "key string, q int, axis int"))
    slim = entries.join(pids, "key").select("scheme_id", "rule_id", "state_scope", "supersedes_rule_id", "q", "axis", *predicate_index.slim_columns())
    none = F.array().cast("array<int>")
    of_states = F.when(F.bool_or(F.col("state").isNotNull()), F.array(F.lit(axes["state"]))).otherwise(none)
    listed = rulebase.listed_rules(slim).groupBy("scheme_id").agg(
        F.collect_list(F.struct("state", "q", *SLIM)).alias("rules"), F.array_sort(F.array_union(F.collect_set("axis"), of_states)).alias("axes")
    )
    # A scheme without rules that hold everywhere still has its row.
    active = schemes.where("status = 'active'").select("scheme_id").distinct()
    rows = written_table(active.join(listed, "scheme_id", "left"), "lists")
    # Every task reads all profiles, so there are no more of them than that.
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-schemes.count() // TASK_SCHEMES))
    return rows.repartitionByRange(tasks, F.coalesce("axes", none), "scheme_id").select("scheme_id", "rules"), held


def _axes(numbered, found, names):
    """The axes of the predicates: thresholds per slot, other predicates of a field by a few, and the state, which comes first."""
    import numpy as np

    thresholds, others = predicate_index.threshold_arrays(found.thresholds), {pid: i for i, pid in enumerate(found.other_pids)}
    ordered = {int(pid): slot for slot, (_, by_op) in thresholds.items() for pids, _, _ in by_op.values() for pid in pids}
    axes, axis_of, own = [{"kind": "state", "slot": -1}], np.zeros(len(numbered), np.int64), {}
    slots = numbered["slot"].fillna(-1).astype(int)
    fields = {f: i for i, f in enumerate(sorted(numbered["field"].fillna("").unique()))}
    for slot in sorted(thresholds):
        own["slot", slot] = len(axes)
        axes.append({"kind": "places", "slot": slot, "values": thresholds[slot][0]})
    for pid, slot, field in sorted(zip(numbered["pid"], slots, numbered["field"].fillna("")), key=lambda x: (x[2], x[1], x[0])):
        if pid in ordered:
            axis_of[pid] = own["slot", ordered[pid]]
            continue
        last = own.get(("field", field, slot))
        if last is None or len(axes[last]["columns"]) == AXIS_OTHERS:
            last = own["field", field, slot] = len(axes)
            axes.append({"kind": "others", "slot": slot, "columns": [], "pids": []})
        # Predicates of unknown operators have no results: never determined.
        axes[last]["columns"].append(others.get(pid, -1))
        axes[last]["pids"].append(int(pid))
        axis_of[pid] = last
    for a in axes:
        codes = 2 * (2 * len(a["values"]) + 3) if a["kind"] == "places" else 256
        a["type"] = "u1" if codes <= 1 << 8 else "u2" if codes <= 1 << 16 else "u4"
    return {
        "axes": axes, "axis_of": axis_of, "slots": thresholds, "n_others": len(found.other_pids), "states": list(names),
        "slot_of": slots.to_numpy("int64"), "field_of": numbered["field"].fillna("").map(fields).to_numpy("int64"), "key": numbered["key"].tolist(),
    }


def _written_codes(placed, axes):
    """The profiles as blocks of codes, one column per axis, and the codes that occur on each axis."""
    held = placed.sparkSession.sparkContext.broadcast({k: axes[k] for k in ("axes", "states", "n_others")})
    count = len(axes["axes"])

    def encoded(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                codes = [pa.array([c.tobytes()], pa.binary()) for c in _codes(batch, held.value)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), *codes], ["n", *[f"c{i}" for i in range(count)]])

    blocks = placed.mapInArrow(encoded, "n long, " + ", ".join(f"c{i} binary" for i in range(count)))
    # Few files: each is opened by all tasks.
    written = written_table(blocks.repartition(placed.sparkSession.sparkContext.defaultParallelism), "profiles")

    def occurring(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, axis in enumerate(held.value["axes"]):
                found = np.unique(_joined(batch.column(f"c{i}"), axis["type"])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i)), pa.array(found)], ["axis", "code"])

    return written, written.mapInArrow(occurring, "axis long, code long").distinct().toPandas()


def _joined(column, kind):
    """The codes of several blocks end to end."""
    import numpy as np

    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.dtype(kind))


def _codes(batch, held):
    """A code per profile and axis: the state; place among the thresholds, or results in three digits; and whether the field is filled."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = batch.num_rows
    populated = batch.column("populated")
    filled = np.zeros((n, len(model.PROFILE_FIELDS) + 1), np.int64)  # the last column: fields outside the vocabulary
    lengths = populated.value_lengths().to_numpy(zero_copy_only=False)
    filled[np.repeat(np.arange(n), lengths), populated.flatten().to_numpy(zero_copy_only=False)] = 1
    flat = batch.column("others").flatten()
    digits = flat.fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    digits[flat.is_null().to_numpy(zero_copy_only=False)] = 0
    digits = digits.reshape(n, held["n_others"])
    numbers = batch.column("numbers").flatten()
    missing = numbers.is_null().to_numpy(zero_copy_only=False).reshape(n, -1)
    numbers = numbers.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(n, -1)
    for axis in held["axes"]:
        if axis["kind"] == "state":
            yield pc.index_in(batch.column("state"), pa.array(held["states"])).to_numpy(zero_copy_only=False).astype(axis["type"])
            continue
        if axis["kind"] == "places":
            values, x = axis["values"], numbers[:, axis["slot"]]
            code = np.searchsorted(values, x, "left") + np.searchsorted(values, x, "right")
            code[np.isnan(x)] = 2 * len(values) + 1
            code[missing[:, axis["slot"]]] = 2 * len(values) + 2
        else:
            code = np.zeros(n, np.int64)
            for j, column in enumerate(axis["columns"]):
                if column >= 0:
                    code += digits[:, column] * 3**j
        yield (2 * code + filled[:, axis["slot"]]).astype(axis["type"])


def _ranked(axes, seen):
    """Axes by the number of their codes, most first, and predicates by axis and threshold; `axes` is brought into that order.

    Returns (key, number, axis) of every predicate.
    """
    import numpy as np

    codes = [np.sort(seen["code"][seen["axis"] == i].to_numpy("int64")) for i in range(len(axes["axes"]))]
    order = sorted(range(len(codes)), key=lambda i: (-len(codes[i]), i))
    rank = np.argsort(order)
    place = np.zeros(len(axes["key"]), np.int64)
    for _, by_op in axes["slots"].values():
        for pids, places, _ in by_op.values():
            place[pids] = places[0]
    axis_of = rank[axes["axis_of"]] if len(place) else np.zeros(0, np.int64)
    pids = np.lexsort((np.arange(len(place)), place, axis_of))
    q = np.argsort(pids)
    results = {}
    for slot, (values, by_op) in axes["slots"].items():
        for op, (own, places, never) in by_op.items():
            for i, pid in enumerate(own):
                results[int(q[pid])] = (op, int(places[0][i]), int(places[-1][i]), bool(never[i]), len(values))
    for a in axes["axes"]:
        for j, pid in enumerate(a.get("pids", ())):
            results[int(q[pid])] = (None, j)
    keys = [(key, int(q[pid]), int(axis_of[pid])) for pid, key in enumerate(axes["key"])]
    axes.update(
        names=order, types=[axes["axes"][i]["type"] for i in order], codes=[codes[i] for i in order], results=results, state=int(rank[0]),
        axis_of=axis_of[pids], slot_of=axes["slot_of"][pids], field_of=axes["field_of"][pids],
    )
    for k in ("key", "axes", "slots"):
        del axes[k]
    return keys


class _Rules:
    """The lists of rules of a shard: rules sorted by list and predicate, and the profiles that a list holds for."""

    def __init__(self, batches, held):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        states = held["states"]
        self.schemes, parts = [], {k: [] for k in ("scheme", "state", "q", *SLIM)}
        for batch in batches:
            rules = batch.column("rules")
            lengths = rules.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = rules.flatten()
            parts["scheme"].append(len(self.schemes) + np.repeat(np.arange(batch.num_rows), lengths))
            parts["state"].append(pc.index_in(flat.field("state"), pa.array(states)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
            for k in ("q", *SLIM):
                parts[k].append(flat.field(k).to_numpy(zero_copy_only=False))
            self.schemes += batch.column("scheme_id").to_pylist()
        kinds = {"phase": np.int8, **dict.fromkeys(FLAGS, bool)}
        flat = {k: np.concatenate(v).astype(kinds.get(k, np.int64)) if v else np.zeros(0, np.int64) for k, v in parts.items()}
        order = np.lexsort((flat["q"], flat["state"], flat["scheme"]))
        flat = {k: v[order] for k, v in flat.items()}
        # A list per scheme and state, and one without rules where none hold everywhere.
        width = len(states) + 1
        wanted = np.union1d(np.arange(len(self.schemes)) * width, flat["scheme"] * width + flat["state"] + 1)
        own = np.searchsorted(wanted, flat["scheme"] * width + flat["state"] + 1)
        self.scheme, self.state = wanted // width, wanted % width - 1
        self.length = np.bincount(own, minlength=len(wanted))
        self.start = np.cumsum(self.length) - self.length
        self.q = flat["q"]
        phase = flat["phase"]
        self.rules = {"a": phase == ord("A"), "b": phase == ord("B"), "c": phase == ord("C"), **{k: flat[k] for k in (*FLAGS, *NUMBERS)}}
        # Each field and slot of a list counts once.
        fields = int(held["field_of"].max(initial=0)) + 1
        self.n_required = np.bincount(np.unique(own * fields + held["field_of"][self.q]) // fields, minlength=len(wanted))
        slot = held["slot_of"][self.q]
        mapped = np.flatnonzero(slot >= 0)
        _, first = np.unique(own[mapped] * (len(model.PROFILE_FIELDS) + 1) + slot[mapped], return_index=True)
        self.counted = np.zeros(len(self.q), np.int8)
        self.counted[mapped[first]] = 1

    def patterns(self):
        """(selected states, predicates) -> lists. A list is selected by None: all profiles; or (True, its states); or (False, others')."""
        found, others = {}, {}
        for scheme, state in zip(self.scheme.tolist(), self.state.tolist()):
            if state >= 0:
                others.setdefault(scheme, []).append(state)
        q, rows = self.q.tolist(), zip(self.scheme.tolist(), self.state.tolist(), self.start.tolist(), self.length.tolist())
        for i, (scheme, state, start, length) in enumerate(rows):
            selected = (True, (state,)) if state >= 0 else (False, tuple(others[scheme])) if scheme in others else None
            found.setdefault((selected, tuple(q[start : start + length])), []).append(i)
        return found


class _Axes:
    """Classes of the predicates over the codes of their axis: 2 * (result + 1) + whether the field is filled, in runs."""

    def __init__(self, held):
        self.held, self.known = held, {}

    def classes(self, q):
        """Class of each code of the predicate's axis."""
        import numpy as np

        codes = self.held["codes"][self.held["axis_of"][q]]
        base, filled = codes >> 1, codes & 1
        op, *own = self.held["results"][q]
        if op is None:
            return 2 * (base // 3 ** own[0] % 3) + filled
        first, last, never, size = own
        left, right = base // 2, (base + 1) // 2
        true = {
            "LT": lambda: first >= right, "LTE": lambda: first >= left, "GT": lambda: first < left, "GTE": lambda: first < right,
            "BETWEEN": lambda: (first < right) & (last >= left),
        }[op]()
        result = np.where(base == 2 * size + 2, -1, true & (not never) & (base <= 2 * size))
        return 2 * (result + 1) + filled

    def runs(self, part):
        """(axis, starts of the runs, class of each run) of a predicate, or of (state axis, selection): 1 if selected."""
        import numpy as np

        if part not in self.known:
            if isinstance(part, tuple):
                axis = self.held["state"]
                classes = (np.isin(self.held["codes"][axis], part[1]) == part[0]).astype(np.int64)
            else:
                axis, classes = int(self.held["axis_of"][part]), self.classes(part)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(classes)) + 1])
            self.known[part] = (axis, starts, classes[starts])
        return self.known[part]

    def cut(self, part, cuts):
        """Class of a predicate in each of the runs that begin at `cuts`."""
        import numpy as np

        _, starts, classes = self.runs(part)
        return classes[np.searchsorted(starts, cuts, "right") - 1]

    def table(self, axis, values):
        """The values of an axis' codes, by code."""
        import numpy as np

        codes = self.held["codes"][axis]
        table = np.zeros(int(codes[-1]) + 1, np.int64)
        table[codes] = values
        return table

    def steps(self, axis, cuts, stride=1):
        """What each code of an axis adds to the place in a histogram."""
        import numpy as np

        return np.repeat(np.arange(len(cuts)) * stride, np.diff([*cuts, len(self.held["codes"][axis])]))

    def packs(self, axes):
        """Axes in packs of a bounded number of joint codes; one with more of its own is a pack by itself."""
        found, cells = [], PACKED
        for axis in axes:
            cells *= len(self.held["codes"][axis])
            if cells > PACKED:
                found.append([])
                cells = len(self.held["codes"][axis])
            found[-1].append(axis)
        return [tuple(pack) for pack in found]

    def pack(self, pack, columns, n):
        """One code per profile for a pack of axes."""
        import numpy as np

        if len(pack) == 1:
            return columns[pack[0]]
        sizes = [len(self.held["codes"][a]) for a in pack]
        tables = [self.table(a, np.arange(size) * int(np.prod(sizes[i + 1 :]))) for i, (a, size) in enumerate(zip(pack, sizes))]
        joint = np.empty(n, np.uint16)
        for low in range(0, n, STEP):
            joint[low : low + STEP] = sum(table.take(columns[a][low : low + STEP]) for a, table in zip(pack, tables))
        return joint


class _Group:
    """Patterns that share a histogram: its axes, each with the cuts of all their predicates."""

    def __init__(self):
        self.cuts, self.cells, self.patterns = {}, 1, []

    def taken(self, pattern, limit):
        """Add a pattern if the histogram stays within the limit."""
        wider, cells = {}, self.cells
        for axis, starts in pattern.starts.items():
            before = self.cuts.get(axis, frozenset((0,)))
            wider[axis] = before | starts
            cells = cells // len(before) * len(wider[axis])
        if cells > limit:
            return False
        self.cuts.update(wider)
        self.cells = cells
        self.patterns.append(pattern)
        return True

    def begun(self, axes, packs, total):
        import numpy as np

        self.axes = sorted(self.cuts)
        self.at = {a: np.array(sorted(self.cuts[a])) for a in self.axes}
        self.shape = [len(self.at[a]) for a in self.axes]
        strides = [int(np.prod(self.shape[i + 1 :])) for i in range(len(self.shape))]
        steps = {a: axes.steps(a, self.at[a], stride) for a, stride in zip(self.axes, strides)}
        self.tables = []
        for pack in packs:
            if not steps.keys().isdisjoint(pack):
                table = np.zeros(1, np.int64)
                for a in pack:
                    table = (table[:, None] + steps.get(a, np.zeros(len(axes.held["codes"][a]), np.int64))).reshape(-1)
                self.tables.append((pack, table if len(pack) > 1 else axes.table(pack[0], table)))
        self.counts = np.zeros(self.cells, np.int32 if total < 1 << 31 else np.int64)

    def count(self, columns, n):
        """Add a block of profiles, the codes of each pack of axes."""
        import numpy as np

        if not self.tables:
            self.counts += n
            return
        whole = np.empty(n, np.int64) if self.cells > STEP // 4 else None
        for low in range(0, n, STEP):
            (pack, table), *others = self.tables
            at = table.take(columns[pack][low : low + STEP])
            for pack, table in others:
                at += table.take(columns[pack][low : low + STEP])
            if whole is None:
                self.counts += np.bincount(at, minlength=self.cells).astype(self.counts.dtype)
            else:
                whole[low : low + STEP] = at
        if whole is not None:
            self.counts += np.bincount(whole, minlength=self.cells).astype(self.counts.dtype)

    def over(self, own, sums):
        """The histogram over some of the axes, from the smallest of the sums so far; axes go one at a time, the longest first."""
        wanted = set(own)
        axes = min((known for known in sums if wanted.issubset(known)), key=lambda known: sums[known].size)
        while len(axes) > len(own):
            found = sums[axes]
            at = max((i for i, a in enumerate(axes) if a not in wanted), key=lambda i: found.shape[i])
            axes = axes[:at] + axes[at + 1 :]
            sums[axes] = found.sum(axis=at)
        return sums[axes]

    def counted(self, axes):
        """(pattern, combinations as classes, counts) of each pattern; patterns follow each other by their axes."""
        import numpy as np

        sums, maps = {tuple(self.axes): self.counts.reshape(self.shape).astype(float)}, {}
        kept, steps = None, []  # the axes that `steps[0]` still has, and sums over more and more of their parts
        for pattern in self.patterns:
            own = tuple(pattern.starts)
            if own != kept:
                kept, steps, done = own, [self.over(own, sums).reshape(1, -1)], []
            same = next((i for i, (x, y) in enumerate(zip(done, pattern.parts)) if x != y), min(len(done), len(pattern.parts)))
            del steps[same + 1 :]
            done = pattern.parts
            for axis, members in pattern.parts[same:]:
                if (axis, members) not in maps:
                    maps[axis, members] = _merged(axes, members, self.at[axis])
                merge = maps[axis, members][0]
                before = steps[-1]
                steps.append(np.matmul(merge, before.reshape(before.shape[0], merge.shape[1], -1)).reshape(before.shape[0] * merge.shape[0], -1))
            flat = steps[-1].reshape(-1)
            places = np.flatnonzero(flat)
            if len(places):
                classes = [maps[part][1] for part in pattern.parts]
                index = np.unravel_index(places, [len(c) for c in classes]) if classes else ()
                yield pattern, pattern.combined([c[i] for c, i in zip(classes, index)], len(places)), flat[places].astype(np.int64)
        self.counts = None


def _merged(axes, members, cuts):
    """(own classes x runs) sums, and the class of each member in each own class; of a selection, the sum over what is selected."""
    import numpy as np

    if isinstance(members[0], tuple):
        return axes.cut(members[0], cuts)[None, :].astype(float), np.zeros((1, 0), np.int64)
    seen = np.stack([axes.cut(q, cuts) for q in members], axis=1)
    if len(members) <= 4:
        weights = CLASSES ** np.arange(len(members))
        present = np.zeros(CLASSES ** len(members), bool)
        joint = seen @ weights
        present[joint] = True
        own, joint = (np.cumsum(present) - 1)[joint], np.flatnonzero(present)
        classes = joint[:, None] // weights % CLASSES
    else:
        classes, own = np.unique(seen, axis=0, return_inverse=True)
        own = own.reshape(-1)
    return (own[None, :] == np.arange(len(classes))[:, None]).astype(float), classes


class _Pattern:
    """A selection of states and the predicates of a list: parts by axis, with the starts of their runs."""

    def __init__(self, axes, selected, qs, lists):
        import numpy as np

        self.lists, self.qs, self.starts, self.constant = np.array(lists), qs, {}, []
        members = {}
        for column, part in [*enumerate(qs), *([(None, selected)] if selected else [])]:
            axis, starts, classes = axes.runs(part)
            if column is not None and len(starts) == 1:
                self.constant.append((column, int(classes[0])))
                continue
            members.setdefault(axis, []).append((column, part))
            self.starts[axis] = self.starts.get(axis, frozenset()).union(starts.tolist())
        self.starts = dict(sorted(self.starts.items()))
        self.parts = [(a, tuple(part for _, part in members[a])) for a in self.starts]
        self.columns = [column for a in self.starts for column, _ in members[a] if column is not None]
        self.cells = 1
        for starts in self.starts.values():
            self.cells *= len(starts)
        self.key = (tuple(self.starts), tuple(part for _, part in self.parts))

    def combined(self, found, n):
        """(combinations x rules) classes from those of each part."""
        import numpy as np

        classes = np.empty((n, len(self.qs)), np.int8)
        if self.columns:
            classes[:, self.columns] = np.concatenate(found, axis=1)
        for column, value in self.constant:
            classes[:, column] = value
        return classes

    def counted(self, axes, columns, n):
        """The combinations of a block of profiles and their counts, without a histogram."""
        import numpy as np

        rows, tables = None, []
        for axis, members in self.parts:
            cuts = np.array(sorted(self.starts[axis]))
            merge, classes = _merged(axes, members, cuts)
            table = axes.table(axis, axes.steps(axis, cuts))
            if isinstance(members[0], tuple):
                rows = np.flatnonzero(merge[0][table].take(columns[axis]))
            else:
                tables.append((axis, merge.argmax(axis=0)[table], classes))
        size = n if rows is None else len(rows)
        at, cells = np.zeros(size, np.int64), 1
        for axis, table, classes in tables:
            codes = columns[axis] if rows is None else columns[axis][rows]
            if cells * len(classes) >= 1 << 62:
                known, at = np.unique(at, return_inverse=True)
                cells = len(known)
            at, cells = at * len(classes) + table.take(codes), cells * len(classes)
        _, first, counts = np.unique(at, return_index=True, return_counts=True)
        places = first if rows is None else rows[first]
        # The state's part has no columns; the others come in the order of `parts`.
        found = [classes[table.take(columns[axis][places])] for axis, table, classes in tables]
        return self.combined(found, len(first)), counts


class _Totals:
    """Combinations that wait to be decided, by the number of their rules, and the totals so far."""

    def __init__(self, rules):
        self.rules, self.waiting, self.sums = rules, {}, []

    def add(self, pattern, classes, counts):
        length = classes.shape[1]
        blocks, cells = self.waiting.get(length, ([], 0))
        blocks.append((pattern.lists, classes, counts))
        cells += len(pattern.lists) * len(classes) * max(1, length)
        self.waiting[length] = (blocks, cells)
        if cells >= DECIDED_CELLS:
            self.decide(length)

    def decide(self, length):
        import numpy as np

        blocks, _ = self.waiting.pop(length)
        lists = np.concatenate([np.repeat(own, len(counts)) for own, _, counts in blocks])
        classes = np.concatenate([c for own, c, _ in blocks for _ in own])
        counts = np.concatenate([c for own, _, c in blocks for _ in own])
        step = max(1, DECIDED_CELLS // max(1, length))
        for low in range(0, len(lists), step):
            self.fold(lists[low : low + step], classes[low : low + step], counts[low : low + step])

    def fold(self, lists, classes, counts):
        """Add the pairs of some combinations, (combination x rule) classes, to the totals of their schemes."""
        import numpy as np

        length = classes.shape[1]
        at = self.rules.start[lists][:, None] + np.arange(length)
        own = {k: v[at] for k, v in self.rules.rules.items()}
        own |= {
            "lengths": np.array([length]), "starts": np.zeros(1, np.int64), "position": np.zeros(1, np.int64), "pid": np.arange(length),
            "n_required": self.rules.n_required[lists][:, None], "required": np.ones((1, length), np.int32),
        }
        out = predicate_index.folded((classes >> 1) - 1, (classes & 1) * self.rules.counted[at], own)
        status = np.zeros(len(lists), np.int64)
        for i, name in enumerate(STATUSES):
            status[out["status"][:, 0] == name] = i
        sums = np.stack([counts, *[out[c][:, 0] * counts for c in COUNTERS]])
        composite = out["composite"][:, 0]
        self.sums.append(_summed(self.rules.scheme[lists] * len(STATUSES) + status, sums, composite, composite))
        if len(self.sums) >= 64:
            self.sums = [self.total()]

    def total(self):
        import numpy as np

        if not self.sums:
            return np.zeros(0, np.int64), np.zeros((1 + len(COUNTERS), 0), np.int64), np.zeros(0), np.zeros(0)
        return _summed(*[np.concatenate(x, axis=-1) for x in zip(*self.sums)])

    def finished(self):
        for length in list(self.waiting):
            self.decide(length)
        return self.total()


def _summed(key, sums, low, high):
    import numpy as np

    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(sums[:, order], starts, axis=1), np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)


def _profile_blocks(held, axes, rows):
    """(codes of each of the axes, profiles) of blocks of about so many profiles, filled over the ends of files."""
    import numpy as np
    import pyarrow.parquet as pq

    names = [f"c{held['names'][a]}" for a in axes]

    def joined(kept):
        columns = {a: np.concatenate([_joined(b.column(name), held["types"][a]) for b in kept]) for a, name in zip(axes, names)}
        return columns, sum(int(np.sum(b.column("n").to_numpy())) for b in kept)

    kept, n = [], 0
    for name in held["files"]:
        with shared_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1, columns=["n", *names]):
                own = batch.column("n")[0].as_py()
                if n + own > rows and kept:
                    yield joined(kept)
                    kept, n = [], 0
                kept.append(batch)
                n += own
    if kept:
        yield joined(kept)


def _counted(batches, held, cells, combinations):
    import numpy as np
    import pyarrow as pa

    rules = _Rules(batches, held)
    if not rules.schemes or not len(held["codes"][held["state"]]):
        return
    axes, totals = _Axes(held), _Totals(rules)
    groups, wide = [_Group()], []
    patterns = [_Pattern(axes, selected, qs, lists) for (selected, qs), lists in rules.patterns().items()]
    for pattern in sorted(patterns, key=lambda p: p.key):
        if pattern.cells > combinations:
            wide.append(pattern)
        elif not groups[-1].taken(pattern, combinations):
            groups.append(_Group())
            groups[-1].taken(pattern, combinations)
    rows = max(1, cells // len(held["types"]))
    while groups or wide:
        own, size = [], 0
        while groups and (not own or size + groups[0].cells <= HELD_CELLS):
            own.append(groups.pop(0))
            size += own[-1].cells
        shared = sorted({a for group in own for a in group.cuts})
        packs = axes.packs(shared)
        for group in own:
            group.begun(axes, packs, held["profiles"])
        for columns, n in _profile_blocks(held, sorted({*shared, *[a for p in wide for a in p.starts]}), rows):
            packed = {pack: axes.pack(pack, columns, n) for pack in packs}
            for group in own:
                group.count(packed, n)
            for pattern in wide:
                classes, counts = pattern.counted(axes, columns, n)
                totals.add(pattern, classes, counts)
        for group in own:
            for found in group.counted(axes):
                totals.add(*found)
        wide = []
    key, sums, low, high = totals.finished()
    if len(key):
        schemes = np.array(rules.schemes, object)[key // len(STATUSES)]
        columns = [pa.array(schemes, pa.string()), pa.array(np.array(STATUSES, object)[key % len(STATUSES)], pa.string()), *[pa.array(x) for x in sums], pa.array(low), pa.array(high)]
        yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in TOTALS.split(", ")])
