"""The run store: what nights publish, the thresholds and rules they ran under, and which run speaks for a day.

Everything is Parquet under one folder. A run writes its tables under (as_of, run_id, attempt) and
then, last of all, one commit record; readers go by commit records. So a run that dies is
invisible, however much it has written, and a run that is repeated replaces what it had published
in one step. Nothing is changed in place; ``vacuum`` deletes attempts that no commit names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.operators.baselines import FitSettings
from ledgerscope.operators.detectors import Tuning
from ledgerscope.operators.typology import DEFAULT_RULES, TEMPLATES, Rule, validate

_OVERRIDE = "struct<outlier_z:double,moderate_z:double,materiality_floor:double>"
SETTINGS = (
    "outlier_z:double,moderate_z:double,materiality_floor:double,min_observations:int,min_span_days:int,lag_days:int,window_days:int,"
    f"mcc_overrides:map<string,{_OVERRIDE}>"
)
RULES = "array<struct<instance_id:string,template:string,enabled:boolean,params:map<string,double>,mcc_scope:array<string>,custom:boolean,label:string>>"
OPENED = f"run_id long, as_of date, started_at timestamp_ntz, settings struct<{SETTINGS}>, rules {RULES}, label string, triggered_by string"
COMMITS = "run_id long, attempt string, alert_count long, finished_at timestamp_ntz"
VALUES = f"key string, version long, settings struct<{SETTINGS}>, rules {RULES}, updated_at timestamp_ntz, updated_by string"


def settings_row(t: Tuning, s: FitSettings) -> dict:
    overrides = {mcc: {f: float(v[f]) if f in v else None for f in ("outlier_z", "moderate_z", "materiality_floor")} for mcc, v in t.mcc_overrides.items()}
    return {
        "outlier_z": float(t.outlier_z), "moderate_z": float(t.moderate_z), "materiality_floor": float(t.materiality_floor), "min_observations": s.min_observations,
        "min_span_days": s.min_span_days, "lag_days": s.lag_days, "window_days": s.window_days, "mcc_overrides": overrides,
    }


def settings_of(row) -> tuple[Tuning, FitSettings]:
    """Thresholds of a stored row; overrides hold what an MCC sets itself, the rest is inherited."""
    overrides = {mcc: {k: v for k, v in o.asDict().items() if v is not None} for mcc, o in (row["mcc_overrides"] or {}).items()}
    tuned = Tuning(row["outlier_z"], row["materiality_floor"], overrides, row["moderate_z"])
    return tuned, FitSettings(**{k: row[k] for k in ("min_observations", "min_span_days", "lag_days", "window_days")})


def rule_rows(rules: list[Rule]) -> list[dict]:
    return [
        {"instance_id": r.name, "template": r.template, "enabled": r.enabled, "params": {k: float(v) for k, v in r.params.items()}, "mcc_scope": list(r.mcc_scope), "custom": r.custom, "label": r.label}
        for r in rules
    ]


def rules_of(rows) -> list[Rule]:
    """Rules of stored rows. One of a template that is gone is left out, and so is a parameter that its template has no more: a retired rule must not stop a night."""
    known = [r for r in rows if r["template"] in TEMPLATES]
    return [
        Rule(r["template"], {k: v for k, v in (r["params"] or {}).items() if k in TEMPLATES[r["template"]]}, r["instance_id"], r["enabled"], tuple(r["mcc_scope"] or ()), bool(r["custom"]), r["label"])
        for r in known
    ]


class RunStore:
    """Runs, their tables, and the thresholds and rules in force, in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], datetime] = datetime.now) -> None:
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock

    def _read(self, name: str, schema: str | None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None if schema is None else self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, row: dict) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    # ---- thresholds and rules ----

    def _latest(self, key: str):
        return self._read("values", VALUES).where(F.col("key") == key).orderBy(F.desc("version")).first()

    def _save(self, key: str, by: str | None, **value) -> None:
        before = self._latest(key)
        row = {"key": key, "version": 1 + (before["version"] if before else 0), "settings": None, "rules": None, "updated_at": self.clock(), "updated_by": by}
        self._append("values", VALUES, row | value)

    def save_settings(self, tuning: Tuning, fit: FitSettings, by: str | None = None) -> None:
        """Replace all thresholds; earlier versions stay on record with who saved them."""
        self._save("detection", by, settings=settings_row(tuning, fit))

    def load_settings(self) -> tuple[Tuning, FitSettings]:
        row = self._latest("detection")
        return settings_of(row["settings"]) if row else (Tuning(), FitSettings())

    def save_rules(self, rules: list[Rule], by: str | None = None) -> None:
        """Replace the whole set of rules; a set with a fault is refused as a whole."""
        validate(rules)
        self._save("rules", by, rules=rule_rows(rules))

    def load_rules(self) -> list[Rule]:
        """The rules in force; without any saved, every template at its defaults."""
        row = self._latest("rules")
        return rules_of(row["rules"]) if row and row["rules"] else list(DEFAULT_RULES)

    def history(self) -> DataFrame:
        """All versions of thresholds and rules, with who saved them and when."""
        return self._read("values", VALUES)

    # ---- runs ----

    def open_run(self, as_of: datetime, label: str | None = None, triggered_by: str | None = None) -> int:
        """A new run's number. What it will run under is recorded now, so that later changes can't be taken for it.

        Two nights that open at a time get two numbers: a number's record can be made only once.
        """
        rules, settings = rule_rows(self.load_rules()), settings_row(*self.load_settings())
        run_id = 1 + (self._opened().agg(F.max("run_id")).first()[0] or 0)
        while True:
            row = {"run_id": run_id, "as_of": as_of.date(), "started_at": self.clock(), "settings": settings, "rules": rules, "label": label, "triggered_by": triggered_by}
            try:
                self.spark.createDataFrame([row], OPENED).coalesce(1).write.mode("error").parquet(f"{self.folder}/opened/number={run_id}")
                return run_id
            except AnalysisException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                run_id += 1

    def _opened(self) -> DataFrame:
        """Records of all opened runs; the folder's number serves to make a record only once."""
        return self._read("opened", OPENED)

    def settings_of_run(self, run_id: int) -> tuple[Tuning, FitSettings, list[Rule]]:
        """What a run was opened under."""
        row = self._opened().where(F.col("run_id") == run_id).first()
        if row is None:
            raise ValueError(f"no run {run_id}")
        return *settings_of(row["settings"]), rules_of(row["rules"])

    def publish(self, run_id: int, made: Mapping[str, DataFrame], count: str = "alerts") -> None:
        """Write a run's tables and commit it; from then on it is what its day's readers see.

        A run that is published again, after it died or to replace what it said, writes beside what is
        there and takes its place with the commit.
        """
        row = self._opened().where(F.col("run_id") == run_id).first()
        if row is None:
            raise ValueError(f"no run {run_id}")
        attempt = uuid.uuid4().hex
        for name, df in made.items():
            df.write.parquet(f"{self.folder}/tables/{name}/as_of={row['as_of']}/run_id={run_id}/attempt={attempt}")
        n = self.spark.read.parquet(f"{self.folder}/tables/{count}/as_of={row['as_of']}/run_id={run_id}/attempt={attempt}").count() if count in made else 0
        self._append("commits", COMMITS, {"run_id": run_id, "attempt": attempt, "alert_count": n, "finished_at": self.clock()})

    def _committed(self) -> DataFrame:
        """(run_id, attempt, alert_count, finished_at): of each run the last commit."""
        last = F.max(F.struct("finished_at", "attempt", "alert_count")).alias("c")
        return self._read("commits", COMMITS).groupBy("run_id").agg(last).select("run_id", "c.attempt", "c.alert_count", "c.finished_at")

    def runs(self) -> DataFrame:
        """Published runs: what they ran under, their alerts, and when a later run of the day superseded them.

        Runs stay on record; of a day's runs the one committed last is not superseded.
        """
        day = Window.partitionBy("as_of").orderBy("finished_at", "run_id")
        both = self._opened().join(self._committed(), "run_id")
        return both.withColumn("superseded_at", F.lead("finished_at").over(day))

    def read(self, name: str, current: bool = False) -> DataFrame:
        """A published table with ``as_of, run_id, superseded_at`` of the runs that published it; ``current`` leaves superseded ones out.

        The runs are few; the join on (as_of, run_id, attempt) prunes the folders that are read.
        """
        rows = self._read(f"tables/{name}", None)
        if rows is None:
            raise ValueError(f"nothing is published as {name}")
        runs = self.runs().select("as_of", "run_id", "attempt", "superseded_at")
        live = runs.where("superseded_at is null") if current else runs
        typed = rows.withColumns({"as_of": F.col("as_of").cast("date"), "run_id": F.col("run_id").cast("long"), "attempt": F.col("attempt").cast("string")})
        return typed.join(live, ["as_of", "run_id", "attempt"]).drop("attempt")

    def vacuum(self) -> int:
        """Delete attempts without a commit, of all runs but those opened after the last commit; the number deleted.

        A night in progress has opened after the last commit, so its files are let alone.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        kept = {r["attempt"] for r in self._committed().collect()}
        last = self._read("commits", COMMITS).agg(F.max("finished_at")).first()[0]
        done = {r["run_id"] for r in self._opened().where(F.col("started_at") < F.lit(last)).collect()} if last else set()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/tables/*/*/*/*")
        system, gone = top.getFileSystem(conf), 0
        for status in system.globStatus(top) or []:
            path = status.getPath()
            attempt, run = path.getName().partition("=")[2], path.getParent().getName().partition("=")[2]
            if attempt not in kept and int(run) in done:
                gone += bool(system.delete(path, True))
        return gone

    # ---- what analysts add ----

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to an append-only table: decisions and events of cases."""
        rows.write.mode("append").parquet(f"{self.folder}/records/{name}")

    def records(self, name: str, schema: str) -> DataFrame:
        return self._read(f"records/{name}", schema)
