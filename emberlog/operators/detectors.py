"""Detectors that can be registered, switched and configured.

A detector turns entries into findings. The registry holds them on the driver;
the plan it makes is the union of those switched on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.findings import as_findings, union_findings
from emberlog.operators.rates import detect_api_abuse
from emberlog.operators.signatures import detect_off_hours, detect_sensitive_data
from emberlog.schema import FINDINGS, empty

Detect = Callable[..., DataFrame]


@dataclass
class Detector:
    """``detect(entries, ingest_ts=..., **config)`` gives findings."""

    id: str
    name: str
    detect: Detect
    version: str = "1.0"
    author: str = ""
    description: str = ""
    config: dict = field(default_factory=dict)
    enabled: bool = True

    def run(self, entries: DataFrame, ingest_ts: datetime | str) -> DataFrame:
        found = self.detect(entries, ingest_ts=ingest_ts, **self.config)
        tags = F.create_map(F.lit("plugin_id"), F.lit(self.id), F.lit("plugin_name"), F.lit(self.name))
        none = F.create_map().cast("map<string,string>")
        return found.withColumn("extra", F.map_concat(F.coalesce("extra", none), tags))


class DetectorRegistry:
    """Detectors by id; starts with the built-in three."""

    def __init__(self, detectors: Iterable[Detector] | None = None):
        self._detectors: dict[str, Detector] = {}
        for detector in builtin_detectors() if detectors is None else detectors:
            self.register(detector)

    def register(self, detector: Detector) -> None:
        self._detectors[detector.id] = detector

    def unregister(self, detector_id: str) -> bool:
        return self._detectors.pop(detector_id, None) is not None

    def enable(self, detector_id: str) -> bool:
        return self._switch(detector_id, True)

    def disable(self, detector_id: str) -> bool:
        return self._switch(detector_id, False)

    def _switch(self, detector_id: str, on: bool) -> bool:
        if detector_id not in self._detectors:
            return False
        self._detectors[detector_id].enabled = on
        return True

    def configure(self, detector_id: str, **config) -> bool:
        if detector_id not in self._detectors:
            return False
        self._detectors[detector_id].config.update(config)
        return True

    def list(self) -> list[dict]:
        return [{"id": d.id, "name": d.name, "version": d.version, "author": d.author,
                 "description": d.description, "enabled": d.enabled, "config": dict(d.config)}
                for d in self._detectors.values()]

    def run_all(self, entries: DataFrame, *, ingest_ts: datetime | str) -> DataFrame:
        """Findings of every detector that is on."""
        parts = [d.run(entries, ingest_ts) for d in self._detectors.values() if d.enabled]
        return union_findings(*parts) if parts else empty(entries.sparkSession, FINDINGS)

    def run_one(self, detector_id: str, entries: DataFrame, *, ingest_ts: datetime | str) -> DataFrame:
        """Findings of one detector; none if it is unknown or off."""
        detector = self._detectors.get(detector_id)
        if detector is None or not detector.enabled:
            return empty(entries.sparkSession, FINDINGS)
        return detector.run(entries, ingest_ts)


def builtin_detectors() -> list[Detector]:
    return [
        Detector("api_abuse", "API Abuse Detector", detect_api_abuse,
                 description="Too many API calls of one address"),
        Detector("sensitive_data", "Sensitive Data Detector", detect_sensitive_data,
                 description="Passwords, keys, card numbers and addresses in lines"),
        Detector("anomalous_time", "Anomalous Time Detector", detect_off_hours,
                 description="Activity outside working hours"),
    ]


def batch_detector(id: str, name: str, detect: Callable[[pd.DataFrame], pd.DataFrame], *,
                   columns: list[str], **about) -> Detector:
    """A detector from a pandas function, for what expressions cannot say.

    It gets Arrow batches of ``columns`` plus ``log_file`` and ``line_number`` and
    returns the rows it objects to, with ``type``, ``severity``, ``detail``, ``score``.
    """
    return Detector(id, name, partial(_run_batches, detect=detect, columns=columns, rule=id), **about)


def _run_batches(entries: DataFrame, *, ingest_ts, detect, columns: list[str], rule: str, **_) -> DataFrame:
    names = list(dict.fromkeys(["log_file", "line_number", "source_ip", *columns]))
    schema = "log_file string, line_number bigint, source_ip string, type string, severity string, detail string, score double"
    wanted = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            found = detect(batch)
            if len(found):
                yield found[wanted]

    return as_findings(entries.select(*names).mapInPandas(run, schema), rule, ingest_ts=ingest_ts)


def detector_stats(entries: DataFrame, findings: DataFrame, registry: DetectorRegistry) -> DataFrame:
    """Processed entries and findings of each detector that is on."""
    on = [(d["id"],) for d in registry.list() if d["enabled"]]
    spark = entries.sparkSession
    ids = spark.createDataFrame(on, "plugin_id string")
    processed = entries.agg(F.count(F.lit(1)).alias("n"))
    # one number for all detectors: put it beside each id
    each = processed.select(F.explode(F.array(*[F.lit(i[0]) for i in on])).alias("plugin_id"),
                            F.col("n").alias("entries_processed")) if on else ids.withColumn(
        "entries_processed", F.lit(0).cast("bigint"))
    found = findings.groupBy(F.col("extra")["plugin_id"].alias("plugin_id")).agg(F.count(F.lit(1)).alias("detections"))
    return each.join(found, "plugin_id", "left").select(
        "plugin_id", "entries_processed", F.coalesce("detections", F.lit(0)).alias("detections"))
