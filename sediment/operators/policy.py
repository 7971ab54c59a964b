"""Rules on command lines, as expressions over arrays of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commands that may not be run.
DENIED = (
    "rm dd mkfs shred wipefs fdisk parted mkswap truncate shutdown reboot poweroff halt init systemctl service kill killall pkill "
    "useradd userdel usermod groupadd groupdel passwd visudo chmod chown chattr setfacl su sudo doas runuser setpriv "
    "mount umount iptables nft crontab at sh bash zsh ksh csh tcsh dash eval exec source ssh scp sftp rsync docker podman kubectl nsenter chroot"
).split()
#: Words of a shell that are refused, and options that name a user.
OPERATORS = ("|", "||", "&", "&&", ";", ">", ">>", "<", "<<", "`", "$(")
USER_FLAGS = ("-u", "--user", "--uid", "--username", "--owner")
MAX_ARGS, MAX_LENGTH = 32, 512


def placeholders(template: Column) -> Column:
    """Distinct names in braces, in order."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1)))


def denied(words: Column, strict: bool, deny: tuple[str, ...] = tuple(DENIED)) -> Column:
    """The first denied name: strictly in any part of any word by its last path element, else only where a word is the bare name; null if none."""
    low = lambda x: F.lower(x)
    if strict:
        parts = F.flatten(F.transform(words, lambda w: F.split(w, r"[\s;|&()`$<>\"']+", -1)))
        names = F.transform(F.filter(parts, lambda p: p != ""), lambda p: low(F.regexp_extract(p, r"([^/]*)$", 1)))
    else:
        names = F.filter(F.transform(words, lambda w: low(F.btrim(w))), lambda w: ~F.contains(w, F.lit("/")) & ~F.startswith(w, F.lit("-")))
    return F.get(F.filter(names, lambda n: n.isin(*deny)), 0)


def token_problem(words: Column) -> Column:
    """args, control, length or operator; null if all words pass."""
    return (
        F.when(F.size(words) > MAX_ARGS, "args")
        .when(F.exists(words, lambda w: w.rlike(r"[\x00-\x1f\x7f]")), "control")
        .when(F.exists(words, lambda w: F.length(w) > MAX_LENGTH), "length")
        .when(F.exists(words, lambda w: w.isin(*OPERATORS)), "operator")
    )


def other_user(words: Column, user: Column, flags: tuple[str, ...] = USER_FLAGS) -> Column:
    """The first value by which an option names another user: "-u x", "--user=x" or "-ux"; null if none."""
    flat = F.filter(F.flatten(F.transform(words, lambda w: F.split(F.btrim(w), r"\s+", -1))), lambda w: w != "")
    me = F.lower(F.btrim(user))
    short = [f for f in flags if len(f) == 2]

    def value(w: Column, i: Column) -> Column:
        low, head = F.lower(w), F.split_part(F.lower(w), F.lit("="), F.lit(1))
        nxt = F.get(flat, i + 1)
        return (
            F.when(F.contains(w, F.lit("=")) & head.isin(*flags), F.substr(w, F.length(head) + 2, F.length(w)))
            .when(low.isin(*flags), F.when(~F.startswith(nxt, F.lit("-")), nxt))
            .when((F.length(w) > 2) & F.substr(low, F.lit(1), F.lit(2)).isin(*short), F.substr(w, F.lit(3), F.length(w)))
        )

    return F.get(F.filter(F.transform(flat, value), lambda v: v.isNotNull() & (v != "") & (F.lower(v) != me)), 0)


def self_named(words: Column, names: tuple[str, ...]) -> Column:
    """Whether a word holds one of the agent's own names."""
    return F.exists(words, lambda w: F.lower(w).rlike("|".join(names)))


def cast_argument(value: Column, kind: Column, choices: Column) -> Column:
    """(value, problem): whole numbers for int, one of the choices for enum, text else.

    A choice "value: label" has one word, a colon and a blank before its label; any other is a value as it stands.
    """
    allowed = F.transform(choices, lambda c: F.regexp_replace(F.btrim(c), r"(?s)^(\S+):\s+\S.*$", "$1"))
    bad = F.when((kind == "int") & value.try_cast("long").isNull(), "int").when((kind == "enum") & ~F.array_contains(allowed, value), "enum")
    return F.struct(F.when(bad.isNull(), F.when(kind == "int", value.try_cast("long").cast("string")).otherwise(value)).alias("value"), bad.alias("problem"))


def render(template: Column, values: Column) -> Column:
    """Words of a template with placeholders replaced; word bounds are those before replacing, and words left empty go."""
    words = F.filter(F.split(F.btrim(template), r"\s+", -1), lambda w: w != "")
    filled = F.transform(words, lambda w: F.aggregate(F.map_entries(values), w, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit("")))))
    return F.filter(filled, lambda w: w != "")


def argument_slots(slots: int, row: Column) -> Column:
    """Structs of name, type, required, default and choices from flat columns arg{k}_name and so on of a map; unnamed slots go."""
    cell = lambda k, c: F.btrim(F.coalesce(F.try_element_at(row, F.lit(f"arg{k}_{c}")), F.lit("")))
    one = lambda k: F.struct(
        cell(k, "name").alias("name"), F.coalesce(F.nullif(cell(k, "type"), F.lit("")), F.lit("str")).alias("type"), cell(k, "required").isin("1", "true", "yes", "y", "TRUE").alias("required"), F.nullif(cell(k, "default"), F.lit("")).alias("default"),
        F.filter(F.transform(F.split(cell(k, "choices"), "\n", -1), lambda x: F.btrim(x)), lambda x: x != "").alias("choices"),
    )
    return F.filter(F.array(*[one(k) for k in range(1, slots + 1)]), lambda s: s["name"] != "")
