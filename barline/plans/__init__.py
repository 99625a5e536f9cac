"""Registered queries. Importing the modules fills the registry."""

from importlib import import_module

MODULES = (
    "windows", "quality", "alignment", "targets", "xsection", "metrics", "intraday", "textual", "landing", "studies",
    "scenarios", "streams",
)


def load() -> None:
    for name in MODULES:
        import_module(f"barline.plans.{name}")
