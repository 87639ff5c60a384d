"""Full reconstruction of all incidents in one job: telemetry, services and their edges in, a star of tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators import graph, report, signals
from emberline.operators.signals import Settings


class Star(dict):
    """Tables by name, each planned when first asked for, from those before it."""

    def __init__(self, builders: dict[str, Callable[[Star], DataFrame]]):
        super().__init__()
        self.builders = builders

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.builders[name](self)
        return self[name]

    def all(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in self.builders}


def reconstruct(telemetry: DataFrame, services: DataFrame, service_edges: DataFrame, settings: Settings = Settings(), system: str = "platform") -> Star:
    """The tables of all incidents by name. Anomalies, one row a service and incident, and one an incident, are computed
    once and kept in the checkpoint folder: they are small beside the telemetry and all that follows reads them. Then
    ``classified`` is the telemetry with a column more, read where it is used, with only the columns that are used."""
    architecture = lambda: telemetry.where("source_type = 'architecture'").groupBy("incident_key").agg(F.array(F.min_by("id", F.struct("ts", "seq"))).alias("arch_ids"))
    return Star(
        {
            "anomalies": lambda s: graph.cut(signals.anomalies(telemetry)),
            "trouble": lambda s: graph.cut(signals.first_trouble(telemetry, s["anomalies"])),
            "classified": lambda s: signals.classify(telemetry, s["trouble"]),
            "signals": lambda s: graph.cut(signals.failure_signals(s["classified"], s["anomalies"], settings)),
            "origins": lambda s: signals.origins(s["signals"]),
            "changes": lambda s: signals.correlate(s["classified"].where("signal = 'change'"), s["origins"], settings),
            "propagation": lambda s: graph.cut(graph.propagate(s["signals"], s["origins"], services, service_edges)),
            "affected": lambda s: graph.affected(s["propagation"], s["origins"]),
            "impacts": lambda s: report.impacts(s["signals"], s["origins"], services),
            "facts": lambda s: graph.cut(report.facts(s["classified"], s["anomalies"], s["signals"], s["origins"], s["changes"], s["impacts"], s["propagation"], settings)),
            "timeline": lambda s: report.timeline(s["classified"], s["anomalies"], s["signals"], s["facts"], services),
            "hypotheses": lambda s: report.hypotheses(s["facts"], architecture()),
            "gaps": lambda s: report.missing_evidence(s["facts"], report.silent_services(s["classified"], s["facts"], services)),
            "actions": lambda s: report.actions(s["facts"]),
            "texts": lambda s: report.texts(s["facts"], s["timeline"], s["hypotheses"], s["actions"], system),
            "dangling": lambda s: report.dangling(s["timeline"], s["hypotheses"], s["propagation"], telemetry),
            "briefings": lambda s: report.briefings(s["facts"], s["texts"], s["hypotheses"], s["gaps"], s["actions"]),
        }
    )
