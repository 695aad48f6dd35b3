"""Address patterns."""

OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_STRICT = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{_STRICT}(?:\.{_STRICT}){{3}}"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_TAIL = rf"(?:{_GROUP}|{IPV4})"
#: Either eight groups, or fewer with one "::" standing for the rest; the last two may be an IPv4 address.
IPV6 = "(?:" + "|".join([
    rf"(?:{_GROUP}:){{7}}{_GROUP}", rf"(?:{_GROUP}:){{6}}{IPV4}",
    *[rf"(?:{_GROUP}:){{{n - 1}}}{_GROUP}::(?:(?:{_GROUP}:){{0,{6 - n}}}{_GROUP}|(?:{_GROUP}:){{0,{max(0, 5 - n)}}}{IPV4})?" for n in range(1, 6)],
    rf"(?:{_GROUP}:){{5}}{_GROUP}::{_GROUP}", rf"(?:{_GROUP}:){{6}}{_GROUP}::", rf"(?:{_GROUP}:){{5}}{_GROUP}::",
    rf"::(?:(?:{_GROUP}:){{0,6}}{_GROUP}|(?:{_GROUP}:){{0,5}}{IPV4})?",
]) + ")"
