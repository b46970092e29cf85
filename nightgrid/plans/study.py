"""Study graphs: named steps that build DataFrames from others, kept subject by subject.

A step runs for all subjects that lack it at once; which those are is read from a manifest.

*Manifest.* One row for each (study, step, subject) and run: its state (ok, warn, fail, pruned), code and message. A run has a number of its own. A step's rows are stored under
that number (``<folder>/<study>/<step>/run=<n>``) first; the manifest's rows follow, and only then are they seen: readers join a step's table with the manifest, so
what a killed run left behind is never read. The newest row of a subject counts.

*What runs.* For each subject, from the last step backwards: a step counts as there if all later ones are; that comes before ``rerun``, and only ``force`` beats it. The
subjects of the study are anti-joined with the manifest, so adding a subject computes this subject alone. Other subjects' files are neither read nor written.

*Failures.* A subject without its inputs, or one whose kernel raised (``guarded``), is marked and left out of later steps; the others go on. If a step's
job as a whole ends in an error, its subjects are split in halves until those that fail stand alone (``ISOLATE`` jobs at the most; who is left in a failing group then is marked
too, and tried again in the next run).

*Whole-table steps* (``per_subject=False``: models, folds, norms) depend on all subjects: they run again when anything that they need has a newer run.
"""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nightgrid.sources.scratch import exists, hadoop_path

OK, WARN, FAIL, PRUNED = "ok", "warn", "fail", "pruned"
CODES = ("EXTRACT_FAILED", "PREDICT_FAILED", "MISSING_INPUT", "MISSING_DEPENDENCY")
MANIFEST = "study string, step string, subject string, run long, state string, code string, message string"
#: Jobs that a failing step may take to find the subjects on which it fails.
ISOLATE = 400
#: The subject of steps that depend on all subjects.
EVERYONE = "*"
SUBJECT, ERROR, WARNING = "subject_id", "_error", "_warning"


@dataclass(frozen=True)
class Step:
    """``build`` gets a dict of input frames and gives one frame.

    ``requires`` may use wildcards (``all``: whatever is there); ``optional`` inputs may be absent, and ``^suffix`` stands for what later steps need that ends so. ``keep``: stored.
    ``touches``: streams that this step consumes for good; unless it gives them back under their name, later steps do not see them.
    ``final``: stays when a study is pruned; ``events`` too, as far as this filter goes (a SQL condition on its rows).
    """

    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    requires: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    keep: bool = True
    per_subject: bool = True
    touches: tuple[str, ...] = ()
    final: bool = False
    events: str | None = None


@dataclass
class Study:
    """Steps in order; ``children`` hang further studies on the end of this one (a tree)."""

    name: str
    steps: list[Step]
    children: list["Study"] = field(default_factory=list)

    def problems(self, sources: tuple[str, ...] = ()) -> list[str]:
        """R2: requirements that nothing before them gives, or that a step before has consumed."""
        known, out = list(sources), []
        for s in self.steps:
            out += [f"{s.name} needs {r}" for r in s.requires if r != "all" and not fnmatch.filter(known, r)]
            known = [k for k in known if not any(fnmatch.fnmatch(k, t) for t in s.touches)] + [s.name]
        for c in self.children:
            out += c.problems(tuple(known))
        return out

    def optional_of(self, place: int) -> tuple[str, ...]:
        """Optional inputs, with ``^suffix`` as the later steps' needs that end so."""
        out = []
        for o in self.steps[place].optional:
            later = [r for s in self.steps[place + 1 :] for r in (*s.requires, *s.optional) if not r.startswith("^") and r.endswith(o[1:])]
            out += later if o.startswith("^") else [o]
        return tuple(dict.fromkeys(out))

    def last_use(self) -> dict[str, str]:
        """The step after which each input is not needed any more."""
        out = {}
        for i, s in enumerate(self.steps):
            for r in (*s.requires, *self.optional_of(i)):
                for k in [x.name for x in self.steps] + list(out):
                    if r == "all" or fnmatch.fnmatch(k, r):
                        out[k] = s.name
                out[r] = s.name
        return out

    def needed(self, cached: set[str], rerun: set[str] = frozenset(), force: set[str] = frozenset()) -> list[str]:
        """R3 for one subject: the steps that run, given those that it has."""
        run, later = [], True
        for i, s in reversed(list(enumerate(self.steps))):
            there = s.name not in force and ((later and i < len(self.steps) - 1) or (s.name not in rerun and s.name in cached))
            if not there:
                run.append(s.name)
            later = later and there
        return run[::-1]


def guarded(df: DataFrame, kernel: Callable[[pa.Table], pa.Table], schema: str, subject: str = SUBJECT) -> DataFrame:
    """``kernel`` for each subject's rows; where it raises, the subject has one row with ``_error`` alone. The runner marks such subjects and keeps the others."""
    full = StructType.fromDDL(schema)
    names = [f.name for f in full.fields]

    def run(table: pa.Table) -> pa.Table:
        try:
            out = kernel(table)
            return out.select(names).append_column(ERROR, pa.nulls(out.num_rows, pa.string()))
        except Exception as e:  # what a subject's data raise is this subject's state
            who = table.column(subject).slice(0, 1)
            return pa.table({subject: who, ERROR: pa.array([f"{type(e).__name__}: {e}"[:300]])})

    def padded(table: pa.Table) -> pa.Table:
        out = run(table)
        if out.column_names == [*names, ERROR]:
            return out
        fields = {f.name: f.type for f in _arrow(full)}
        return pa.table({n: out.column(n) if n in out.column_names else pa.nulls(out.num_rows, fields[n]) for n in (*names, ERROR)})

    return df.groupBy(subject).applyInArrow(padded, f"{schema}, {ERROR} string")


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType(schema.fields).add(ERROR, "string"))


class Runner:
    """Runs studies over a table folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._last_run = 0

    # ---- manifest

    def _path(self, study: str, step: str) -> str:
        return f"{self.folder}/{study}/{step}"

    def manifest(self) -> DataFrame:
        """All rows of all runs up to now.

        The files are named one by one: Spark takes two scans of one folder for the same and may reuse an exchange over the older of them.
        """
        path = f"{self.folder}/_manifest"
        files = []
        if exists(self.spark, path):
            fs, p = hadoop_path(self.spark, path)
            files = sorted(n for x in fs.listStatus(p) if (n := x.getPath().toString()).endswith(".parquet"))
        return self.spark.read.schema(MANIFEST).parquet(*files) if files else self.spark.createDataFrame([], MANIFEST)

    def log_table(self) -> DataFrame:
        return self.manifest()

    def state(self, study: str | None = None) -> DataFrame:
        """``study, step, subject, run, state, code, message`` as they are now: the newest row of each."""
        m = self.manifest() if study is None else self.manifest().filter(F.col("study") == study)
        return m.groupBy("study", "step", "subject").agg(F.max(F.struct("run", "state", "code", "message")).alias("x")).select("study", "step", "subject", "x.*")

    def _commit(self, rows: DataFrame) -> None:
        rows.select("study", "step", "subject", F.col("run").cast("long").alias("run"), "state", "code", "message").write.mode("append").parquet(f"{self.folder}/_manifest")

    def _new_run(self) -> int:
        """Later than every run before, by the clock in microseconds."""
        seen = self.manifest().agg(F.max("run")).first()[0] or 0
        self._last_run = max(time.time_ns() // 1000, seen + 1, self._last_run + 1)
        return self._last_run

    # ---- tables

    def table(self, study: str, step: str, subject: str = SUBJECT) -> DataFrame | None:
        """The rows of a step that the manifest vouches for; None if there is no such run."""
        valid = self.state(study).filter((F.col("step") == step) & F.col("state").isin(OK, WARN)).select(F.col("subject").alias("_subject"), F.col("run").alias("_run"))
        path = self._path(study, step)
        runs = sorted(r[0] for r in valid.select("_run").distinct().collect())  # one row a run
        runs = [r for r in runs if exists(self.spark, f"{path}/run={r}")]
        if not runs:
            return None
        df = self.spark.read.option("basePath", path).option("mergeSchema", len(runs) > 1).parquet(*[f"{path}/run={r}" for r in runs])
        if subject in df.columns:
            df = df.join(valid, (F.col(subject).cast("string") == F.col("_subject")) & (F.col("run") == F.col("_run")), "left_semi")
        else:
            df = df.filter(F.col("run") == runs[-1])
        return df.drop("run", ERROR, WARNING)

    # ---- one run

    def run(
        self, study: Study, sources: dict[str, DataFrame], rerun: set[str] = frozenset(), force: set[str] = frozenset(), outputs: tuple[str, ...] = ("*",), subjects: DataFrame | None = None, subject: str = SUBJECT
    ) -> dict[str, DataFrame]:
        """What is missing is computed and stored; gives the frames whose names match ``outputs``.

        ``subjects``: a frame with the subject column; without it, all that the sources hold.
        """
        number = self._new_run()
        have, gone = dict(sources), set()
        todo = self._plan(study, sources, subjects, set(rerun), set(force), subject, number)
        newest: dict[str, int] = {}
        last = study.last_use()
        for i, s in enumerate(study.steps):
            names = [k for k in have if k not in gone]
            inputs, missing = {}, []
            for r in s.requires:
                hits = names if r == "all" else fnmatch.filter(names, r)
                missing += [] if hits or r == "all" else [r]
                inputs |= {h: have[h] for h in hits}
            inputs |= {h: have[h] for r in study.optional_of(i) for h in fnmatch.filter(names, r)}
            produced = {x.name for x in study.steps}
            if not s.per_subject:
                self._whole(study, s, inputs, missing, produced, newest, s.name in force or s.name in rerun, number)
            elif missing:
                code = "MISSING_DEPENDENCY" if any(m in produced for m in missing) else "MISSING_INPUT"
                self._mark(self._open(study, todo, s.name, number), study, s, number, FAIL, code, ", ".join(missing))
            elif s.keep:
                self._subjects(study, s, inputs, produced, self._open(study, todo, s.name, number), subject, number)
            if not s.keep:
                if not missing:
                    have[s.name] = s.build(inputs)
            elif (df := self.table(study.name, s.name, subject)) is not None:
                have[s.name] = df
                if any(not x.per_subject for x in study.steps):
                    newest[s.name] = self.state(study.name).filter((F.col("step") == s.name) & F.col("state").isin(OK, WARN)).agg(F.max("run")).first()[0]
            # Consumed streams are gone for later steps, R6: so are those whose last consumer has run
            gone |= {k for k in names if any(fnmatch.fnmatch(k, t) for t in s.touches) and k != s.name}
            for k in [k for k, at in last.items() if at == s.name and k in have and k not in {x.name for x in study.steps if x.keep} and k not in sources]:
                del have[k]
        for c in study.children:
            seen = {k: v for k, v in have.items() if k not in gone}
            have |= {f"{c.name}/{k}": v for k, v in self.run(c, seen, rerun, force, ("*",), subjects, subject).items() if k not in seen}
        return {k: v for k, v in have.items() if any(fnmatch.fnmatch(k, o) for o in outputs)}

    def _plan(self, study: Study, sources, subjects, rerun: set[str], force: set[str], subject: str, number: int) -> DataFrame:
        """One row a subject: for each step whether it runs. Stored, as the manifest grows while the study runs."""
        if subjects is None:
            ids = [df.select(F.col(subject)) for df in sources.values() if subject in df.columns]
            if not ids:
                raise ValueError(f"no source has a column {subject}")
            subjects = ids[0]
            for x in ids[1:]:
                subjects = subjects.unionByName(x)
        who = subjects.select(F.col(subject).cast("string").alias("subject")).filter("subject IS NOT NULL").distinct()
        steps = [s for s in study.steps if s.per_subject and s.keep]
        there = self.state(study.name).filter(F.col("state").isin(OK, WARN)).groupBy("subject").agg(F.collect_set("step").alias("_there"))
        who = who.join(there, "subject", "left")
        later, flags = F.lit(True), {}
        for i, s in reversed(list(enumerate(steps))):
            own = F.lit(False) if s.name in rerun else F.coalesce(F.array_contains("_there", s.name), F.lit(False))
            is_there = F.lit(False) if s.name in force else (own if i == len(steps) - 1 else later | own)
            flags[s.name] = ~is_there
            later = later & is_there
        # a step that does not run and was not kept cannot be what a later one reads: that one's needs are computed
        plan = who.select("subject", F.array_compact(F.array(*[F.when(f, F.lit(k)) for k, f in flags.items()])).alias("todo")) if flags else who.select("subject", F.array().cast("array<string>").alias("todo"))
        path = f"{self.folder}/_plans/{study.name}/run={number}"
        plan.filter(F.size("todo") > 0).write.parquet(path)
        return self.spark.read.schema("subject string, todo array<string>").parquet(path)

    def _open(self, study: Study, todo: DataFrame, step: str, number: int) -> DataFrame:
        """Subjects that a step runs for: planned, and not failed earlier in this run."""
        failed = self.manifest().filter((F.col("study") == study.name) & (F.col("run") == number) & (F.col("state") == FAIL)).select("subject").distinct()
        return todo.filter(F.array_contains("todo", step)).select("subject").join(failed, "subject", "left_anti")

    def _mark(self, who: DataFrame, study: Study, s: Step, number: int, state: str, code: str = "", message: str = "") -> None:
        self._commit(who.select(F.lit(study.name).alias("study"), F.lit(s.name).alias("step"), "subject", F.lit(number).alias("run"), F.lit(state).alias("state"), F.lit(code).alias("code"), F.lit(message[:300]).alias("message")))

    def _subjects(self, study: Study, s: Step, inputs: dict[str, DataFrame], produced: set[str], who: DataFrame, subject: str, number: int) -> None:
        """A step for the subjects that lack it; the manifest's rows come last."""
        if who.isEmpty():
            return
        lost = None
        for name in inputs:
            if not any(r != "all" and fnmatch.fnmatch(name, r) for r in s.requires):
                continue
            if name in produced:
                has = self.state(study.name).filter((F.col("step") == name) & F.col("state").isin(OK, WARN)).select("subject") if self._kept(study, name) else None
            else:
                has = inputs[name].select(F.col(subject).cast("string").alias("subject")).distinct() if subject in inputs[name].columns else None
            if has is not None:
                code = "MISSING_DEPENDENCY" if name in produced else "MISSING_INPUT"
                gone = who.join(has, "subject", "left_anti").select("subject", F.lit(code).alias("code"), F.lit(name).alias("message"))
                lost = gone if lost is None else lost.unionByName(gone)
        if lost is not None and not lost.isEmpty():
            first = lost.groupBy("subject").agg(F.min(F.struct("code", "message")).alias("x"))
            self._commit(first.select(F.lit(study.name).alias("study"), F.lit(s.name).alias("step"), "subject", F.lit(number).alias("run"), F.lit(FAIL).alias("state"), "x.code", "x.message"))
            failed = self.manifest().filter((F.col("study") == study.name) & (F.col("run") == number) & (F.col("state") == FAIL)).select("subject").distinct()
            who = who.join(failed, "subject", "left_anti")
        self._jobs = 0
        self._attempt(study, s, inputs, who, subject, number, 0, 0)

    def _kept(self, study: Study, name: str) -> bool:
        return any(x.name == name and x.keep and x.per_subject for x in study.steps)

    def _attempt(self, study: Study, s: Step, inputs: dict[str, DataFrame], who: DataFrame, subject: str, number: int, depth: int, part: int) -> None:
        path = f"{self._path(study.name, s.name)}/run={number}"
        mine = who if depth == 0 else who.filter(F.pmod(F.xxhash64("subject"), F.lit(1 << depth)) == part)
        if depth and mine.isEmpty():
            return

        def only(df: DataFrame) -> DataFrame:
            return df.join(mine, F.col(subject).cast("string") == mine["subject"], "left_semi") if subject in df.columns else df

        try:
            df = s.build({k: only(v) for k, v in inputs.items()})
            if subject not in df.columns:
                raise ValueError(f"step {s.name} gives no column {subject}")
            df.write.mode("append").parquet(path)
        except Exception as e:  # a step that fails must not stop the others
            self._jobs += 2
            if self._jobs < ISOLATE and depth < 60 and mine.limit(2).count() > 1:
                for half in (part, part + (1 << depth)):
                    self._attempt(study, s, inputs, who, subject, number, depth + 1, half)
            else:
                self._mark(mine, study, s, number, FAIL, "EXTRACT_FAILED", str(e))
            return
        out = self.spark.read.parquet(path) if exists(self.spark, path) else None
        notes = [c for c in (ERROR, WARNING) if out is not None and c in out.columns]
        rows = mine
        if notes:
            told = out.filter(" OR ".join(f"{c} IS NOT NULL" for c in notes)).groupBy(F.col(subject).cast("string").alias("subject")).agg(*[F.first(c, ignorenulls=True).alias(c) for c in notes])
            rows = mine.join(told, "subject", "left")
        error, warning = (F.col(c) if c in notes else F.lit(None).cast("string") for c in (ERROR, WARNING))
        state = F.when(error.isNotNull(), FAIL).when(warning.isNotNull(), WARN).otherwise(OK)
        code = F.when(error.isNotNull(), "EXTRACT_FAILED").otherwise("")
        self._commit(rows.select(F.lit(study.name).alias("study"), F.lit(s.name).alias("step"), "subject", F.lit(number).alias("run"), state.alias("state"), code.alias("code"), F.coalesce(error, warning, F.lit("")).alias("message")))

    def _whole(self, study: Study, s: Step, inputs: dict[str, DataFrame], missing: list[str], produced: set[str], newest: dict[str, int], again: bool, number: int) -> None:
        one = self.spark.createDataFrame([(EVERYONE,)], "subject string")
        if missing:
            return self._mark(one, study, s, number, FAIL, "MISSING_DEPENDENCY" if any(m in produced for m in missing) else "MISSING_INPUT", ", ".join(missing))
        done = self.state(study.name).filter((F.col("step") == s.name) & F.col("state").isin(OK, WARN)).agg(F.max("run")).first()[0]
        if s.keep and (again or done is None or any(newest.get(k, 0) > done for k in inputs)):
            try:
                s.build(inputs).write.parquet(f"{self._path(study.name, s.name)}/run={number}")
            except Exception as e:
                return self._mark(one, study, s, number, FAIL, "EXTRACT_FAILED", str(e))
            self._mark(one, study, s, number, OK)

    # ---- retention

    def prune(self, study: Study, subject: str = SUBJECT) -> list[str]:
        """IO21: drop what nothing needs any more; gives the removed folders.

        A subject's rows of a step may go when the manifest shows every ``final`` step that follows from it as there for this subject; of a step with ``events`` these rows stay. Final
        tables stay. A subject that lacks a final table keeps all it has. Runs that no row of the manifest vouches for (killed or replaced ones) go as a whole.
        """
        finals = [s.name for s in study.steps if s.final]
        if not finals:
            return []
        number = self._new_run()
        ok = self.state(study.name).filter(F.col("state").isin(OK, WARN))
        done = ok.filter(F.col("step").isin(finals)).groupBy("subject").agg(F.count_distinct("step").alias("n"))
        removed = []
        for s in study.steps:
            if not s.keep or not s.per_subject:
                continue
            path = self._path(study.name, s.name)
            after = [f for f in finals if f in self._reached(study, s.name)]
            complete = done.filter(F.col("n") == len(finals)).select("subject")
            here = ok.filter(F.col("step") == s.name)
            if not s.final and after:
                loose = here.join(complete, "subject").select("subject")
                if s.events and exists(self.spark, path):
                    self._keep_events(study, s, loose, subject, number)
                elif not s.events:
                    self._mark(loose, study, s, number, PRUNED)
            removed += self._sweep(study, s, subject)
        return removed

    def _reached(self, study: Study, name: str) -> set[str]:
        """Steps that follow from a step, through any number of others."""
        out = {name}
        for i, s in enumerate(study.steps):
            if any(r == "all" or fnmatch.fnmatch(x, r) for r in (*s.requires, *study.optional_of(i)) for x in out):
                out.add(s.name)
        return out

    def _keep_events(self, study: Study, s: Step, who: DataFrame, subject: str, number: int) -> None:
        df = self.table(study.name, s.name, subject)
        if df is None or df.filter(f"NOT ({s.events})").isEmpty():
            return
        mine = df.join(who, F.col(subject).cast("string") == who["subject"], "left_semi").filter(s.events)
        mine.write.parquet(f"{self._path(study.name, s.name)}/run={number}")
        self._mark(who, study, s, number, OK)

    def _sweep(self, study: Study, s: Step, subject: str) -> list[str]:
        """Runs in which nobody has a valid row go; runs in which only some have are rewritten without the others' rows."""
        path = self._path(study.name, s.name)
        if not exists(self.spark, path):
            return []
        fs, p = hadoop_path(self.spark, path)
        runs = {int(n[4:]) for x in fs.listStatus(p) if (n := x.getPath().getName()).startswith("run=")}
        valid = self.state(study.name).filter((F.col("step") == s.name) & F.col("state").isin(OK, WARN)).select(F.col("subject").alias("_subject"), "run")
        held = {r["run"]: r["count"] for r in valid.groupBy("run").count().collect()}  # one row a run
        out = []
        for r in sorted(runs):
            where = f"{path}/run={r}"
            if r not in held:
                fs.delete(hadoop_path(self.spark, where)[1], True)
                out.append(where)
                continue
            rows = self.spark.read.parquet(where)
            mine = valid.filter(F.col("run") == r).select("_subject")
            if not rows.join(mine, F.col(subject).cast("string") == F.col("_subject"), "left_anti").isEmpty():
                # written beside, then moved: a reader finds the old files or the new ones
                beside = f"{path}/_rewritten={r}"
                rows.join(mine, F.col(subject).cast("string") == F.col("_subject"), "left_semi").write.mode("overwrite").parquet(beside)
                fs.delete(hadoop_path(self.spark, where)[1], True)
                fs.rename(hadoop_path(self.spark, beside)[1], hadoop_path(self.spark, where)[1])
        return out
