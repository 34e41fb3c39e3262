"""Units of measure: kind, size in the base unit of the kind, offset for temperatures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Size of every unit in the base unit of its kind (g, m, year, Pa, N, J, W, T, teaspoon, kelvin).
MASS = {"g": 1.0, "sg": 1.45938424189287e04, "lbm": 4.5359230974881148e02, "u": 1.66053100460465e-24, "ozm": 2.83495152079732e01}
DISTANCE = {
    "m": 1.0, "mi": 1.609344e03, "Nmi": 1.852e03, "in": 2.54e-02, "ft": 3.048e-01, "yd": 9.144000003e-01, "ang": 1.0e-10,
    "Pica": 3.527777777778e-04,
}
TIME = {"yr": 1.0, "day": 1 / 365.25, "hr": 1 / 8766.0, "mn": 1 / 525960.0, "sec": 1 / 31557600.0}
PRESSURE = {"Pa": 1.0, "p": 1.0, "atm": 1.01324996583e05, "at": 1.01324996583e05, "mmHg": 1.33322363925e02}
FORCE = {"N": 1.0, "dyn": 1.0e-5, "dy": 1.0e-5, "lbf": 4.448222}
ENERGY = {
    "J": 1.0, "e": 1.000000480657e-07, "c": 4.18399101363672, "cal": 4.18679484613929, "eV": 1.60219000146921e-19,
    "ev": 1.60219000146921e-19, "HPh": 2.6845174131617e06, "hh": 2.6845174131617e06, "Wh": 3.5999982055472e03,
    "wh": 3.5999982055472e03, "flb": 1 / 2.37304222192651e01, "BTU": 1 / 9.47815067349015e-04, "btu": 1 / 9.47815067349015e-04,
}
POWER = {"HP": 7.45701e02, "h": 7.45701e02, "W": 1.0, "w": 1.0}
MAGNETISM = {"T": 1.0, "ga": 1.0e-4}
LIQUID = {
    "tsp": 1.0, "tbs": 3.0, "oz": 6.0, "cup": 48.0, "pt": 96.0, "us_pt": 96.0, "uk_pt": 1 / 8.6755851682196e-03, "qt": 192.0,
    "gal": 768.0, "l": 1 / 4.9299940840071e-03, "lt": 1 / 4.9299940840071e-03,
}
TEMPERATURE = {"C": 1.0, "cel": 1.0, "F": 1 / 1.8, "fah": 1 / 1.8, "K": 1.0, "kel": 1.0}
OFFSETS = {"C": 273.15, "cel": 273.15, "F": 273.15 - 32 / 1.8, "fah": 273.15 - 32 / 1.8}
# Units that take a decimal prefix, and the prefixes.
PREFIXABLE = frozenset(
    "g u m ang sec Pa p atm at mmHg N dyn dy J e c cal eV ev Wh wh W w T ga l lt".split()
)
PREFIXES = {
    "Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "e": 1e1,
    "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24,
}
KINDS = {
    "mass": MASS, "distance": DISTANCE, "time": TIME, "pressure": PRESSURE, "force": FORCE, "energy": ENERGY, "power": POWER,
    "magnetism": MAGNETISM, "liquid": LIQUID, "temperature": TEMPERATURE,
}


@dataclass(frozen=True)
class Unit:
    kind: str
    factor: float
    offset: float = 0.0


_PLAIN = {name: Unit(kind, factor, OFFSETS.get(name, 0.0)) for kind, sizes in KINDS.items() for name, factor in sizes.items()}


def unit(name: str) -> Unit | None:
    if name in _PLAIN:
        return _PLAIN[name]
    prefix, rest = name[:1], name[1:]
    if prefix in PREFIXES and rest in PREFIXABLE:
        base = _PLAIN[rest]
        return Unit(base.kind, base.factor * PREFIXES[prefix])
    return None


def unit_table(spark: SparkSession) -> DataFrame:
    """All units with and without prefix, as a table for joins."""
    names = list(_PLAIN) + [p + u for p in PREFIXES for u in sorted(PREFIXABLE) if p + u not in _PLAIN]
    rows = [(n, u.kind, float(u.factor), float(u.offset)) for n in names for u in [unit(n)]]
    return spark.createDataFrame(rows, "unit string, kind string, factor double, offset double")
