"""Imports every plan module so that the registry is complete."""

import importlib

MODULES = [
    "regioscope.plans.neighbourhood",
    "regioscope.plans.establishments",
    "regioscope.plans.tables",
    "regioscope.plans.complexity",
    "regioscope.plans.composite",
    "regioscope.plans.model",
    "regioscope.plans.geo",
    "regioscope.plans.io_plans",
    "regioscope.plans.inputs",
]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(m)
