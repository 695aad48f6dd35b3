"""Predicates on single values: users, commands, processes, files, hosts, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.functions.patterns import IPV4, IPV6
from logsift.functions.text import ascii_lower, trim


def parse_ip(c: Column) -> Column:
    """The address in a value, brackets and a port taken off; null where there is none."""
    bare = F.regexp_replace(trim(c), r"^[\[\]]+|[\[\]]+$", "")
    host = F.regexp_extract(bare, r"^(.*):[0-9]*$", 1)
    is_ip = lambda x: x.rlike(f"^(?:{IPV4}|{IPV6})$")
    return F.when(is_ip(bare), bare).when(is_ip(host), host)


def looks_like_path(c: Column) -> Column:
    return c.rlike(r"(?s)[\\/]|^[A-Za-z]:.")


def is_command_line_like(c: Column) -> Column:
    """A known tool with arguments, or a program file followed by something."""
    value = trim(c)
    low = ascii_lower(value)
    # fixed values
    tool = low.rlike(r"powershell|pwsh|cmd\.exe|wmic|rundll32|mshta|regsvr32|certutil|bitsadmin|schtasks|wscript|cscript")
    arguments = low.rlike(r' /c | -enc| -encodedcommand| -nop| --| /| -|="')
    program = low.contains(".exe") & value.rlike(r"\S\s+\S")
    return (F.octet_length(value) >= 12) & ((tool & (arguments | (F.octet_length(value) >= 30))) | program)


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(trim(c), r'^"+|"+$', "")


def is_process_name_like(c: Column) -> Column:
    value = _unquoted(c)
    base = ascii_lower(F.regexp_extract(value, r"(?s)([^\\/]*)$", 1))
    named = base.rlike(r"^\s*\S+\s*$") & base.rlike(r"\.(?:exe|dll|ps1|bat|cmd|scr)$")
    return (value != "") & (F.octet_length(value) <= 180) & ~is_command_line_like(value) & named


def is_file_like(c: Column) -> Column:
    value = _unquoted(c)
    extension = value.rlike(r"\.[^.\\/]{2,8}$")
    return (value != "") & ~is_command_line_like(value) & (value.rlike(r"[\\/]|^[A-Za-z]:.") | extension) & ~value.contains("\n")


def is_host_like(c: Column) -> Column:
    value = trim(c)
    return value.rlike(r"^[A-Za-z0-9._-]{1,253}$") & value.rlike("[A-Za-z]") & parse_ip(value).isNull()


def is_user_value(c: Column) -> Column:
    """DOMAIN\\user, user@domain.tld, a security identifier or a plain account name."""
    domain_user = c.rlike(r"^[A-Za-z0-9_-]{1,64}\\[A-Za-z0-9._$-]{1,128}$")
    principal = c.rlike(r"^[A-Za-z0-9._+-]+@[A-Za-z0-9.-]*\.[A-Za-z0-9.-]*[A-Za-z0-9-]$")
    identifier = c.rlike(r"^S-1-[0-9]+(?:-[0-9]+)*$")
    plain = c.rlike(r"^[A-Za-z0-9_$-]{2,64}$") & c.rlike("[A-Za-z]") & parse_ip(c).isNull()
    return domain_user | principal | identifier | plain


def is_identity_like(c: Column) -> Column:
    """A user value that is no path and no program file; a backslash makes a path of it."""
    value = trim(c)
    usable = (value != "") & (F.octet_length(value) <= 256) & ~looks_like_path(value) & ~ascii_lower(value).endswith(".exe")
    return usable & is_user_value(value)


def is_evidence_text(c: Column) -> Column:
    value = trim(c)
    return (F.octet_length(value) >= 25) & value.rlike(r"\s")


def ipv4_number(c: Column) -> Column:
    """An IPv4 address as a number, null for anything else."""
    part = lambda i: F.split(c, r"\.")[i].cast("long")
    return F.when(c.rlike(f"^{IPV4}$"), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def private_ipv4(n: Column) -> Column:
    """10/8, 127/8, 172.16/12, 192.168/16 and 169.254/16."""
    high = F.shiftright(n, 16)
    return F.shiftright(n, 24).isin(10, 127) | (F.shiftright(n, 20) == 0xAC1) | high.isin(0xC0A8, 0xA9FE)
