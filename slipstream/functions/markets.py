"""Market taxonomy, teams, players and lines out of export labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# --- fixed values: the taxonomy ------------------------------------------------
BETBUILDER = "BetBuilder"
GOALSCORER = "Goalscorer props"
PLAYER = "Player props"
TEAM = "Team stats"
MATCH = "Match stats"
ENHANCED = "Enhanced 1X2"
OTHER = "Other"

WHOLE_LABELS = {
    "{COMPETITOR1}": ("Team BetBuilder (home)", BETBUILDER),
    "{COMPETITOR2}": ("Team BetBuilder (away)", BETBUILDER),
    "Match": ("Match BetBuilder", BETBUILDER),
    "1-X-2 / 2 goals Up": ("1X2 (2-goal cushion)", ENHANCED),
    "{goalnr}{ordinal} goal scorer": ("Nth goal scorer", GOALSCORER),
    "{CARDNR}st player to be booked": ("Nth player booked", PLAYER),
    "Goles durante el partido": ("Match goals", MATCH),
}
GOALSCORER_WORDS = [
    "goalscorer", "goal scorer", "to score", "hat trick", "score a header",
    "score from outside", "score or assist", "score and assist",
    "first to score", "anytime not to score",
]
PLAYER_WORDS = [
    "{player}", "player ", "most passes", "most fouls", "most tackles",
    "to be carded", "to be booked", "sent off", "to miss a penalty",
    "first foul", "first to be fouled",
]
TEAM_STARTS = ["team", "1st half: team", "2nd half: team"]
MATCH_STARTS = ["match", "1st half", "2nd half", "corners"]
OPTION_IS_PLAYER_WORDS = [
    "most passes", "most fouls", "most tackles", "player to", "to be carded",
    "to be booked", "sent off", "nth player booked",
]
STAR_TAG = r"(?i)\s*\(Star Substitute\)\s*"
NUMBER = r"(\d+(?:\.\d+)?)"
LINE = rf"(?i){NUMBER}\s*or more|over\s*{NUMBER}|under\s*{NUMBER}"
NOT_A_NAME = r"^\d|^Over|^Under"
# -------------------------------------------------------------------------------

# White space in any script: spreadsheets put no-break spaces around texts.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


# One pattern or map lookup per rule keeps the generated code of a whole row
# small enough for the JVM to compile; long chains of tests do not.


def _contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def _starts_any(c: Column, words: list[str]) -> Column:
    return c.rlike("^(?:" + "|".join(re.escape(w) for w in words) + ")")


def _whole_label(raw: Column, part: int) -> Column:
    """The value for a label that is known as a whole, else null."""
    known = F.create_map(*[F.lit(x) for k, v in WHOLE_LABELS.items() for x in (k, v[part])])
    return F.try_element_at(known, raw)


def market_base(raw: Column) -> Column:
    """The label without its star-substitute tag."""
    untagged = strip(F.regexp_replace(raw, STAR_TAG, ""))
    return F.when(star_flag(raw), untagged).otherwise(strip(raw))


def _is_tagged(raw: Column) -> Column:
    return star_flag(raw) & F.coalesce(raw.rlike(STAR_TAG), F.lit(False))


def _is_duel(low: Column) -> Column:
    return low.contains("{player1} vs {player2}")


def market_clean(raw: Column, base: Column, low: Column) -> Column:
    """``base`` is ``market_base`` and ``low`` its lower case: both are read many
    times, so the caller keeps them as columns."""
    readable = (
        F.when(_is_duel(low), F.concat(F.lit("Player duel: "), strip(F.substring_index(base, "-", 1))))
        .when(low.contains("{player}"), strip(F.replace(base, F.lit("{PLAYER}"), F.lit("(player)"))))
        .otherwise(base)
    )
    tagged = F.when(_is_tagged(raw), F.concat(readable, F.lit(" [Star Sub]"))).otherwise(readable)
    return F.coalesce(_whole_label(raw, 0), tagged)


def market_group(raw: Column, low: Column) -> Column:
    """First rule that fits wins; a null label is Other."""
    by_rule = (
        F.when(_is_duel(low) | low.contains("{player}"), PLAYER)
        .when(_contains_any(low, GOALSCORER_WORDS), GOALSCORER)
        .when(_contains_any(low, PLAYER_WORDS), PLAYER)
        .when(_starts_any(low, TEAM_STARTS) | low.contains(" team"), TEAM)
        .when(_starts_any(low, MATCH_STARTS), MATCH)
        .otherwise(OTHER)
    )
    return F.coalesce(_whole_label(raw, 1), by_rule)


def star_flag(raw: Column) -> Column:
    return F.coalesce(F.lower(raw).contains("star substitute"), F.lit(False))


def sides(match: Column) -> Column:
    """[home, away] from 'home - away', split at the first ' - '. Untrimmed."""
    return F.split(match, " - ", 2)


def side(parts: Column, i: int) -> Column:
    """One side of ``sides``; '' where the match names no two sides."""
    return F.when(F.size(parts) > 1, strip(F.get(parts, F.lit(i)))).otherwise("")


def entity_team(raw: Column, group: Column, option: Column, home: Column, away: Column) -> Column:
    def named(side: Column) -> Column:
        return (side != "") & option.startswith(side)

    return (
        F.when(group == TEAM, F.when(named(home), home).when(named(away), away))
        .when(raw == "{COMPETITOR1}", home)
        .when(raw == "{COMPETITOR2}", away)
    )


def entity_player(group: Column, clean_low: Column, option: Column) -> Column:
    """The backed player, where the option holds a name. ``clean_low`` is the
    clean market name in lower case."""
    holds_name = (group == GOALSCORER) | F.coalesce(
        _contains_any(clean_low, OPTION_IS_PLAYER_WORDS), F.lit(False)
    )
    return F.when(holds_name & ~option.rlike(NOT_A_NAME), option)


def extract_line(option: Column) -> Column:
    """The number of the first 'N or more', 'over N' or 'under N'."""
    phrase = F.regexp_extract(option, LINE, 0)
    return F.regexp_extract(phrase, NUMBER, 1).try_cast("double")
