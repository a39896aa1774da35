"""Compiles a request to one lazy DataFrame. Nothing is executed while compiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cache import ResultCache
from ..functions.dates import EVENT, START, END, local_date, usable
from ..operators import groups, leaf as leaves, temporal
from ..sources.catalog import LOGICAL, Catalog, leaf_columns
from .model import AND, DIFFERENT_ENCOUNTER, OR, ORDERED, PATIENT, SAME_ENCOUNTER, SAME_EPISODE, Constraint, Criterion, Group, Leaf, Request, RequestError, walk
from .rewrite import constrained, is_simple, rewritten

_KEY = {SAME_ENCOUNTER: "encounter", DIFFERENT_ENCOUNTER: "encounter", SAME_EPISODE: "episodeOfCare"}
_DATES = (EVENT, START, END)
_EVERYBODY = 1 << 20  # no criterion's id


class Compiled:
    """A request over a catalog. subjects(): the result; stages(): subjects of each criterion.

    one_pass: decide a tree without constraints by flags in a single aggregation; else by semi and anti
    joins. Both give the same subjects. cache: keeps each criterion's subjects for other requests, which takes joins.
    """

    def __init__(self, request: Request, catalog: Catalog, one_pass: bool = True, cache: ResultCache | None = None):
        self.request, self.catalog, self.cache = request, catalog, cache
        self.root, lost = rewritten(request)
        self.warnings = (*request.warnings, *lost)
        self.by_id = request.resource != PATIENT
        if self.by_id and not isinstance(request.root, Leaf):
            raise RequestError(f"a cohort of {request.resource} needs a single basicResource")
        self._check(self.root)
        self.one_pass = one_pass and cache is None and not self.by_id and is_simple(self.root)
        self._sets: dict[int, DataFrame] = {}
        self._place: dict[int, int] = {}
        self._flag_of: dict[int, Leaf | None] = {}
        self._value: dict[int, Column] = {}

    def _check(self, root: Criterion) -> None:
        for node in walk(root):
            if isinstance(node, Group) and node.constraints and node.kind != AND:
                raise RequestError(f"{node.kind} {node.id} cannot have temporal constraints")

    # --- results

    def subjects(self) -> DataFrame:
        """(subject_id), each once."""
        if self.one_pass:
            flagged, value = self._flags()
            return flagged.filter(value[self.root.id]).select(F.col("subject").alias("subject_id"))
        return self.set_of(self.root).select(F.col("subject").alias("subject_id"))

    def population(self) -> DataFrame:
        return self.catalog.population().select(F.col("patient").alias("subject")).distinct()

    def stage_ids(self) -> list[int]:
        """The criteria of the request as given, without those that rewriting added."""
        return [c.id for c in walk(self.request.root)] if self.request.root is not None else []

    def stages(self, ids=None) -> DataFrame:
        """(stage, subject): for each criterion its subjects; for an exclusive one the population's others."""
        wanted = set(self.stage_ids() if ids is None else ids)
        asked = {c.id: c for c in walk(self.request.root)} if self.request.root is not None else {}
        if not wanted <= set(asked):
            raise RequestError(f"no criteria {sorted(wanted - set(asked))}")
        if not wanted:
            raise RequestError("no stages")
        nodes = {c.id: c for c in walk(self.root)}
        if self.one_pass:
            flagged, value = self._flags()
            own = {i: value[i] if nodes[i].inclusive else self._flag_of_all() & ~value[i] for i in sorted(wanted)}
            flagged, _ = self._flags()
            return flagged.select("subject", F.explode(F.array_compact(F.array(*(F.when(v, i) for i, v in own.items())))).alias("stage")).select("stage", "subject")
        out = None
        for i in sorted(wanted):
            node = nodes[i]
            rows = self.set_of(node)
            if not node.inclusive:
                rows = self.population().join(rows, "subject", "left_anti")
            rows = rows.select(F.lit(i).alias("stage"), "subject")
            out = rows if out is None else out.unionAll(rows)
        return out

    def organizations(self) -> DataFrame:
        """(subject_id, organization_ids): every organization that the population or a leaf's rows name for a subject of the result, sorted."""
        found = [self.catalog.population()] if "organizations" in self.catalog.population().columns else []
        for node in walk(self.root):
            if isinstance(node, Leaf) and node.inclusive and "organizations" in leaf_columns(self.catalog, node):
                found.append(self.catalog.scan(node, ["organizations"]))
        result = self.subjects()
        if not found:
            return result.withColumn("organization_ids", F.array().cast("array<bigint>"))
        pairs = reduce(DataFrame.unionAll, (d.select(F.col("patient").alias("subject_id"), F.explode("organizations").alias("o")) for d in found))
        lists = pairs.groupBy("subject_id").agg(F.array_sort(F.collect_set("o")).alias("organization_ids"))
        return result.join(lists, "subject_id", "left").withColumn("organization_ids", F.coalesce("organization_ids", F.array().cast("array<bigint>")))

    # --- one pass

    def _flag(self, key: int, node: Leaf | None) -> Column:
        """The flag of a leaf, or of the population (no leaf)."""
        if key not in self._place:
            self._place[key] = len(self._place)
            self._flag_of[key] = node
        return F.coalesce(F.col(f"f{self._place[key]}"), F.lit(False))

    def _flag_of_all(self) -> Column:
        return self._flag(_EVERYBODY, None)

    def _flags(self) -> tuple[DataFrame, dict[int, Column]]:
        """(subject and a flag for each set), and the condition by which each criterion holds.

        Leaves of one resource that are filters alone share a scan; only the others need an aggregation of their own.
        """
        if not self._value:
            self._decide(self.root)
        alike: dict[str, list[Leaf]] = {}
        single, tagged = [], []
        for key, node in self._flag_of.items():
            if node is None:
                tagged.append(self.catalog.population().select(F.col("patient").alias("subject"), F.lit(self._place[key]).alias("k")))
            elif leaves.plain(node):
                alike.setdefault(node.resource, []).append(node)
            else:
                single.append(node)
        for group in alike.values():
            rows = self.catalog.scan_together(group) if len(group) > 1 else None
            if rows is None:
                tagged += [self.catalog.scan(n, ()).select(F.col("patient").alias("subject"), F.lit(self._place[n.id]).alias("k")) for n in group]
            else:
                places = F.array(*(F.lit(self._place[n.id]) for n in group))
                tagged.append(rows.select(F.col("patient").alias("subject"), F.get(places, F.col("k")).alias("k")))
        tagged += [self._leaf_set(n).select("subject", F.lit(self._place[n.id]).alias("k")) for n in single]
        return groups.flags(tagged, len(self._place)).filter("subject is not null"), self._value

    def _decide(self, node: Criterion) -> Column:
        if isinstance(node, Leaf):
            keep = self._flag(node.id, node)
        else:
            own = {c.id: self._decide(c) for c in node.children}
            inside = [own[c.id] for c in node.included] or [self._flag_of_all()]
            if node.kind == AND:
                keep = reduce(lambda a, b: a & b, inside)
            elif node.kind == OR:
                keep = reduce(lambda a, b: a | b, inside)
            else:
                keep = groups.n_flags(inside, node.n_among_m)
            for c in node.excluded:
                keep = keep & ~own[c.id]
        self._value[node.id] = keep
        return keep

    # --- sets of subjects

    def set_of(self, node: Criterion) -> DataFrame:
        """(subject), each once, before its own exclusion is applied."""
        if node.id not in self._sets:
            make = lambda: self._leaf_set(node) if isinstance(node, Leaf) else self._group_set(node)
            self._sets[node.id] = make() if self.cache is None or self.by_id else self.cache.subjects(node, self.request.cohorts, make)
        return self._sets[node.id]

    def _leaf_set(self, leaf: Leaf) -> DataFrame:
        has = leaf_columns(self.catalog, leaf)
        if self.by_id:
            rows = leaves.qualifying(self._leaf_rows(leaf, {"id"}), leaf, has, False)
            return rows.filter("id is not null").select(F.col("id").alias("subject")).distinct()
        return leaves.patients(self._leaf_rows(leaf, set()), leaf, has).select(F.col("patient").alias("subject"))

    def _leaf_rows(self, leaf: Leaf, columns: set[str]) -> DataFrame:
        has = leaf_columns(self.catalog, leaf)
        return leaves.filtered(self.catalog.scan(leaf, leaves.needed(leaf, has) | columns), leaf, has)

    def _group_set(self, group: Group) -> DataFrame:
        if not group.included:
            found = self.population()
        elif group.kind == OR:
            found = groups.any_of([self.set_of(c) for c in group.included])
        elif group.kind != AND:
            found = groups.n_among([self.set_of(c) for c in group.included], group.n_among_m)
        else:
            related, parts = set(), []
            for constraint, ids in self._applied(group):
                related |= set(ids)
                parts.append(self._related(group, constraint, ids))
            found = groups.all_of([*parts, *(self.set_of(c) for c in group.included if c.id not in related)])
        return groups.without(found, [self.set_of(c) for c in group.excluded])

    # --- rows for constraints

    def _able(self, node: Criterion, constraint: Constraint) -> bool:
        """Whether a criterion's rows have what the constraint compares."""
        if isinstance(node, Group):
            below = [c for c in walk(node) if isinstance(c, Leaf) and c.inclusive]
            return any(self._able(c, constraint) for c in below)
        has = leaf_columns(self.catalog, node)
        if constraint.kind == ORDERED:
            return bool(usable((), node.resource, has))
        return _KEY[constraint.kind] in has

    def _applied(self, group: Group) -> list[tuple[Constraint, tuple[int, ...]]]:
        """The constraints with two criteria or more."""
        found = ((c, constrained(group, c, self._able)) for c in group.constraints)
        return [(c, ids) for c, ids in found if len(ids) > 1]

    def _child(self, group: Group, i: int) -> Criterion:
        return next(c for c in group.children if c.id == i)

    def _key_rows(self, group: Group, constraint: Constraint, ids: tuple[int, ...], columns: set[str]) -> DataFrame:
        key = _KEY[constraint.kind]
        rows = [self.rows_of(self._child(group, i), columns | {key} if k == 0 else {key}) for k, i in enumerate(ids)]
        return temporal.different_key(rows, key) if constraint.kind == DIFFERENT_ENCOUNTER else temporal.same_key(rows, key)

    def _related(self, group: Group, constraint: Constraint, ids: tuple[int, ...]) -> DataFrame:
        if constraint.kind != ORDERED:
            return self._key_rows(group, constraint, ids, set()).select("subject").distinct()
        times, preference, choice = [], dict(constraint.preference), dict(constraint.choices)
        for i in ids:
            node = self._child(group, i)
            has = leaf_columns(self.catalog, node) if isinstance(node, Leaf) else frozenset(_DATES)
            resource = node.resource if isinstance(node, Leaf) else "unknown"
            t = self.rows_of(node, set(_DATES)).select("subject", local_date(preference.get(i, ()), resource, has).alias("t"))
            if choice.get(i, "any") != "any":
                t = t.groupBy("subject").agg((F.min if choice[i] == "first" else F.max)("t").alias("t"))
            times.append(t)
        least = constraint.least.total_seconds() if constraint.least else 0
        most = constraint.most.total_seconds() if constraint.most else None
        return temporal.ordered(times, least, most or None, [constraint.admits_null(i) for i in ids])

    def rows_of(self, node: Criterion, columns: set[str]) -> DataFrame:
        """(subject, *columns): the rows by which a criterion of a constraint holds.

        A leaf's rows are those in qualifying groups of occurrences. A conjunction with a constraint on the
        same key gives the rows that fulfil it, any other group the rows of its criteria, for the group's subjects.
        """
        if isinstance(node, Leaf):
            has = leaf_columns(self.catalog, node)
            rows = leaves.qualifying(self._leaf_rows(node, columns), node, has, True)
            return rows.filter("patient is not null").select(F.col("patient").alias("subject"), *sorted(columns))
        subjects = self.set_of(node)
        for constraint, ids in self._applied(node) if node.kind == AND else ():
            if constraint.kind in _KEY and _KEY[constraint.kind] in columns:
                rows = self._key_rows(node, constraint, ids, columns)
                return rows.select("subject", *sorted(columns)).join(subjects, "subject", "left_semi")
        if not node.included:
            return subjects.select("subject", *(F.lit(None).cast(LOGICAL[c]).alias(c) for c in sorted(columns)))
        rows = reduce(DataFrame.unionAll, (self.rows_of(c, columns) for c in node.included))
        if node.kind == OR and not node.excluded:  # the rows' subjects are the group's
            return rows
        return rows.join(subjects, "subject", "left_semi")
