"""Boxes, periods and folders of a study."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Box:
    south: float
    north: float
    west: float
    east: float

    def __post_init__(self):
        if self.south > self.north:
            raise ValueError("a box has its south below its north")


@dataclass(frozen=True)
class Band:
    """A named region with the season in which it is studied."""

    name: str
    box: Box
    season: str = "all"


@dataclass(frozen=True)
class Folders:
    """Places of raw and made data; ~ and environment variables are expanded."""

    raw: str
    work: str
    made: list[str] = field(default_factory=lambda: ["anomalies", "eof", "types", "composites", "models"])

    @staticmethod
    def of(path: str) -> Path:
        return Path(os.path.expandvars(os.path.expanduser(path)))

    def make(self) -> None:
        for name in self.made:
            (self.of(self.work) / name).mkdir(parents=True, exist_ok=True)

    def check(self) -> None:
        if not self.of(self.raw).is_dir():
            raise FileNotFoundError(f"{self.raw} is not there; is its disk mounted?")


# The regions that are compared, each in its season; the first three meet without overlap.
BANDS = (
    Band("tropics", Box(-20.0, -10.0, 112.0, 154.0), "warm"),
    Band("subtropics", Box(-30.0, -20.0, 112.0, 154.0), "all"),
    Band("midlatitudes", Box(-40.0, -30.0, 112.0, 154.0), "cool"),
    Band("southeast", Box(-40.0, -33.0, 140.0, 150.0), "cool"),
)


@dataclass(frozen=True)
class Domain:
    """Where types are defined and where impacts are measured, the days from start to end, and the hours of a day."""

    typing: Box
    target: Box
    start: str
    end: str
    hours: tuple[int, ...]


def box_of(made: dict) -> Box:
    return Box(made["lat_south"], made["lat_north"], made["lon_west"], made["lon_east"])


def domain_of(made: dict) -> Domain:
    """From the sections typing, target, period and sampling of a read file."""
    period = made["period"]
    return Domain(box_of(made["typing"]), box_of(made["target"]), str(period["start"]), str(period["end"]), tuple(made["sampling"]["hours"]))


@dataclass(frozen=True)
class Source:
    """A place of raw data: its address, its variables by our name of them, and whatever else its section says."""

    name: str
    address: str
    variables: dict[str, str]
    options: dict


def sources_of(made: dict) -> dict[str, Source]:
    """The sections of a read file, each with an address under store, base_url or catalog."""
    out = {}
    for name, section in made.items():
        given = section.get("variables", {})
        variables = given if isinstance(given, dict) else {v: v for v in given}
        address = next((section[k] for k in ("store", "base_url", "catalog") if k in section), None)
        if address is None:
            raise KeyError(f"source {name} has no address")
        out[name] = Source(name, address, variables, {k: v for k, v in section.items() if k not in ("variables", "store", "base_url", "catalog")})
    return out


def load_domain(path: str) -> Domain:
    return domain_of(load_yaml(path))


def load_sources(path: str) -> dict[str, Source]:
    return sources_of(load_yaml(path))


def load_yaml(path: str) -> dict:
    import yaml

    with open(Folders.of(path)) as f:
        return yaml.safe_load(f)
