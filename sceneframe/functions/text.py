"""Names, labels, colours, log tags and status texts as column expressions."""

from pyspark.sql import Column, functions as F

# Fixed value: the characters Python's str.strip() removes.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")

# Log tags in the order in which they are tested.
PREFIX_TAGS = ("tool", "nav", "pose", "voice", "speech", "init", "error")
CONTAINED_TAGS = ("tool", "speech", "voice", "pose", "init", "error")

# Navigation status codes and their names.
STATUS_NAMES = {
    "cloud": {0: "unknown", 1: "accepted", 2: "navigating", 3: "canceling",
              4: "arrived", 5: "canceled", 6: "failed"},
    "local": {0: "unknown", 1: "accepted", 2: "executing", 3: "canceling",
              4: "succeeded", 5: "canceled", 6: "aborted"},
}


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITESPACE))


def name_key(s: Column) -> Column:
    """Key for case-insensitive requests: trimmed and lower-cased."""
    return F.lower(strip(s))


def distance_band(m: Column) -> Column:
    """Spoken distance; each band includes its lower bound."""
    return (F.when(m < 1.0, "right here").when(m < 3.0, "nearby")
            .when(m < 6.0, "a short walk").when(m >= 6.0, "a bit further away"))


def label_color(label: Column) -> Column:
    """Stable colour of a label: struct (r, g, b), each in 30..255."""
    h = F.conv(F.substring(F.md5(label), 1, 6), 16, 10).cast("double")
    hue = (h * 137.508) % 360.0 / 360.0
    sat = (h % 4.0) * 0.075 + 0.7
    val = (h % 3.0) * 0.067 + 0.8
    sector = F.floor(hue * 6.0).cast("double")
    frac = hue * 6.0 - sector
    p = val * (1.0 - sat)
    q = val * (1.0 - sat * frac)
    t = val * (1.0 - sat * (1.0 - frac))
    i = sector % 6.0

    def channel(*by_sector):
        out = F.when(i == 0.0, by_sector[0])
        for n in range(1, 6):
            out = out.when(i == float(n), by_sector[n])
        return F.greatest(F.lit(30), F.least(F.lit(255), F.floor(out * 255.0).cast("int")))

    return F.struct(channel(val, q, p, p, t, val).alias("r"),
                    channel(t, val, val, q, p, p).alias("g"),
                    channel(p, p, t, val, val, q).alias("b"))


def status_name(code: Column, dialect: str = "cloud") -> Column:
    """Name of a status code; no status at all is 'idle' / 'no_goal'."""
    names = STATUS_NAMES[dialect]
    none, other = ("idle", "unknown") if dialect == "cloud" else ("no_goal", "no_goal")
    out = F.when(code.isNull(), none)
    for value, name in names.items():
        out = out.when(code == value, name)
    return out.otherwise(other)


def status_message(code: Column, destination: Column) -> Column:
    """Sentence for a status code.  A missing destination reads 'None'."""
    dest = F.coalesce(destination, F.lit("None"))
    return (F.when(code.isNull(), "No navigation goal active")
            .when(code == 4, F.concat(F.lit("Arrived at "), dest))
            .when(code == 2, F.concat(F.lit("Currently navigating to "), dest))
            .when(code == 6, F.concat(F.lit("Navigation to "), dest,
                                      F.lit(" failed — path may be blocked")))
            .when(code == 5, "Navigation was canceled")
            .otherwise(F.concat(F.lit("Status: "), status_name(code))))


def log_tag(text: Column, mode: str = "prefix") -> Column:
    """Category of a log line, or null.

    ``prefix`` looks at the start of the line; ``contains`` takes the first
    tag of the list found anywhere in it.
    """
    tags = PREFIX_TAGS if mode == "prefix" else CONTAINED_TAGS
    test = F.startswith if mode == "prefix" else F.contains
    out = F.when(test(text, F.lit(f"[{tags[0]}]")), tags[0])
    for tag in tags[1:]:
        out = out.when(test(text, F.lit(f"[{tag}]")), tag)
    return out


def preview(s: Column, n: int = 150, one_line: bool = True) -> Column:
    """A display excerpt: newlines become spaces, then the first n characters."""
    return F.substring(F.replace(s, F.lit("\n"), F.lit(" ")) if one_line else s, 1, n)


def display_path(names_leaf_first: Column) -> Column:
    """'Root > ... > leaf' from an array that starts at the leaf."""
    return F.array_join(F.reverse(names_leaf_first), " > ")


def category(description: Column) -> Column:
    """'8. Find: nearest chair' -> 'Find'; without a number, 'Other'."""
    head = F.split_part(description, F.lit(":"), F.lit(1))
    return F.when(F.contains(description, F.lit(". ")),
                  F.get(F.split(head, r"\. "), F.lit(1))).otherwise("Other")


def contains_any(text: Column, keywords: Column) -> Column:
    low = F.lower(text)
    return F.exists(keywords, lambda k: F.contains(low, F.lower(k)))
