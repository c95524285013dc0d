"""Configuration: sections with defaults, read from a dictionary or a TOML file, checked before any job starts."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from gridweave.functions.naming import voltages
from gridweave.operators.region import ADMIN_LEVELS


class ConfigError(ValueError):
    """A configuration that can't be run."""


@dataclass
class Voltage:
    default: float
    v_nom: list[float] | None = None

    @property
    def rated(self) -> list[float]:
        return voltages(self.v_nom, self.default)


@dataclass
class Voltages:
    lv: Voltage = field(default_factory=lambda: Voltage(0.4))
    mv: Voltage = field(default_factory=lambda: Voltage(10.0))
    hv: Voltage = field(default_factory=lambda: Voltage(110.0))


@dataclass
class AssetInput:
    directory: str = ""
    separator: str = ","
    hierarchic: bool = False


@dataclass
class Input:
    pbf: str = ""
    asset: AssetInput | None = None


@dataclass
class CsvOutput:
    directory: str = ""
    separator: str = ","
    hierarchic: bool = False


@dataclass
class Output:
    grid_name: str = "grid"
    add_timestamp: bool = True
    csv: CsvOutput | None = None
    lv: bool = True
    mv: bool = True
    hv: bool = True


@dataclass
class OsmFilter:
    building: list[str] = field(default_factory=list)
    highway: list[str] = field(default_factory=list)
    landuse: list[str] = field(default_factory=list)


@dataclass
class Lv:
    """Defaults are those that hold where the whole section is missing."""

    average_power_density: float = 12.5
    consider_house_connection_points: bool = False
    load_simultaneous_factor: float = 0.2
    min_distance: float = 10.0
    starting_level: int = 2
    lowest_level: int = 8
    filter: OsmFilter | None = None


@dataclass
class Mv:
    spawn_missing_hv_nodes: bool = True


@dataclass
class Config:
    input: Input = field(default_factory=Input)
    output: Output = field(default_factory=Output)
    voltage: Voltages = field(default_factory=Voltages)
    lv: Lv | None = None
    mv: Mv | None = None

    def with_defaults(self) -> Config:
        """A missing low-voltage section has its defaults; a missing medium-voltage one spawns high-voltage nodes if they are to be written."""
        return Config(self.input, self.output, self.voltage, self.lv or Lv(), self.mv or Mv(self.output.hv))

    @property
    def needs_lv(self) -> bool:
        return self.output.lv or self.output.mv


def build(kind, values: dict):
    """An instance of a section of nested dictionaries; unknown keys raise ConfigError."""
    known = {f.name: f for f in fields(kind)}
    odd = set(values) - set(known)
    if odd:
        raise ConfigError(f"unknown keys in {kind.__name__}: {sorted(odd)}")
    made = {}
    for name, value in values.items():
        section = next((c for c in (Voltage, Voltages, AssetInput, Input, CsvOutput, Output, OsmFilter, Lv, Mv) if c.__name__ in str(known[name].type).split(" | ")), None)
        made[name] = build(section, value) if section and isinstance(value, dict) and is_dataclass(section) else value
    try:
        return kind(**made)
    except TypeError as e:
        raise ConfigError(str(e)) from None


def load(path: str) -> Config:
    if "\\" in path:
        raise ConfigError("the path of a configuration has no backslashes")
    with Path(path).open("rb") as f:
        return build(Config, tomllib.load(f))


def check(config: Config, listeners: int = 0) -> Config:
    """The configuration itself, if it can be run; else ConfigError tells the first rule that it breaks."""
    rules = [
        (config.lv is not None or config.mv is not None, "at least one of lv and mv has to be configured"),
        (bool(config.input.pbf), "input.pbf is missing"),
        (config.input.asset is not None and bool(config.input.asset.directory), "input.asset.directory is missing"),
        (config.output.csv is not None or listeners > 0, "neither a sink nor a listener is there for the result"),
        (config.output.csv is None or bool(config.output.csv.directory and config.output.csv.separator), "output.csv needs a directory and a separator"),
        (config.output.lv or config.output.mv or config.output.hv, "lv, mv and hv output are all off"),
    ]
    if config.lv is not None:
        rules += [
            (config.lv.starting_level in ADMIN_LEVELS and config.lv.lowest_level in ADMIN_LEVELS, f"administrative levels are {ADMIN_LEVELS}"),
            (config.lv.starting_level <= config.lv.lowest_level, "the starting level is below the lowest"),
            (0 <= config.lv.load_simultaneous_factor <= 1, "the simultaneity factor lies between 0 and 1"),
            (config.lv.average_power_density > 0 and config.lv.min_distance >= 0, "density is positive, distance not negative"),
        ]
    for good, what in rules:
        if not good:
            raise ConfigError(what)
    return config
