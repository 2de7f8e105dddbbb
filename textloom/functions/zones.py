"""Zone names and abbreviations understood by the timestamp operators."""

from zoneinfo import available_timezones

# fixed values: abbreviations that state an offset by themselves (EST, CST, PST are North American)
ABBREVIATIONS = {
    "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00",
    "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00",
    "IST": "+05:30", "NPT": "+05:45", "SGT": "+08:00", "HKT": "+08:00", "AWST": "+08:00",
    "KST": "+09:00", "JST": "+09:00", "ACST": "+09:30", "AEST": "+10:00", "ACDT": "+10:30", "AEDT": "+11:00",
    "NZST": "+12:00", "NZDT": "+13:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00",
    "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00",
}


def region_names() -> list[str]:
    """Names of the zone database that are safe to hand to Spark (a bad name makes Spark raise)."""
    return sorted(z for z in available_timezones() if not z.startswith(("SystemV/", "posix/", "right/")) and z not in ("localtime", "Factory", "posixrules"))
