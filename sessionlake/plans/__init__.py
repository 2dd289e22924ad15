"""Named query plans."""

from importlib import import_module

MODULES = ("windows", "clock", "counter", "interval", "stream", "event", "contract", "release", "inventory",
           "evaluation", "classifier", "detection", "pointprocess", "machine", "source", "streams", "health")


def load_all() -> None:
    for name in MODULES:
        try:
            import_module(f"sessionlake.plans.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"sessionlake.plans.{name}":
                raise
