"""All registered queries and their checking SQL."""

from __future__ import annotations

from checks import alerts, files, host, journeys, learn, network, network_flows, streams

MODULES = (host, network_flows, network, alerts, learn, files, streams, journeys)


def queries() -> dict:
    return {name: function for module in MODULES for name, function in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
