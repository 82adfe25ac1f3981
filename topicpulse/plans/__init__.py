"""Named queries over the sample tables."""

from importlib import import_module

MODULES: list[str] = [
    "library",
    "scalars",
    "cleaning",
    "trends",
    "ingest",
    "updates",
    "reports",
    "sources",
    "markup",
    "extraction",
    "matching",
    "streaming",
]


def load() -> None:
    for name in MODULES:
        import_module(f"topicpulse.plans.{name}")
