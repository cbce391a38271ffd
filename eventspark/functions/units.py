"""Time units for approximate durations."""

from __future__ import annotations

# Names of each unit and its length in seconds.
UNITS = {
    "seconds": ("s sec secs second seconds", 1),
    "minutes": ("m min mins minute minutes", 60),
    "hours": ("h hr hrs hour hours", 3_600),
    "days": ("d day days", 86_400),
    "weeks": ("w wk wks week weeks", 604_800),
    "months": ("mo mos month months", 86_400 * 30.436875),
    "years": ("y yr yrs year years", 86_400 * 365.2422),
}
_BY_NAME = {name: (unit, seconds) for unit, (names, seconds) in UNITS.items() for name in names.split()}


def time_unit(name: str) -> tuple[str, float]:
    """Canonical name and seconds of a unit; ``ValueError`` for an unknown one."""
    try:
        return _BY_NAME[name]
    except KeyError:
        known = "\n".join(f"  * {unit}: {', '.join(names.split())}" for unit, (names, _) in UNITS.items())
        raise ValueError(f"Unknown time unit '{name}'. Valid units include:\n{known}") from None
