"""Place names: folding, countries, regions, spellings. Dictionaries are parameters with small defaults."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import places
from .places import countries_in, norm

# Countries of regions.
REGIONS = {
    "european union": "at be bg hr cy cz dk ee fi fr de gr hu ie it lv lt lu mt nl pl pt ro sk si es se",
    "eu": "at be bg hr cy cz dk ee fi fr de gr hu ie it lv lt lu mt nl pl pt ro sk si es se",
    "europe": "gb ie de fr es it nl be pt se dk no fi is pl cz at ch gr ro hu sk bg hr si lt lv ee lu mt cy ua rs",
    "emea": "gb ie de fr es it nl be se dk no fi pl cz at ch pt gr ro hu ae sa il tr eg za ng ke ma",
    "north america": "us ca mx",
    "central america": "mx gt bz sv hn ni cr pa",
    "south america": "br ar cl co pe uy py bo ec ve",
    "latin america": "mx br ar cl co pe uy cr pa gt ec do",
    "latam": "mx br ar cl co pe uy cr pa gt ec do",
    "americas": "us ca mx br ar cl co pe cr pa uy",
    "apac": "au nz sg jp in cn kr hk tw my th ph id vn",
    "asia pacific": "au nz sg jp in cn kr hk tw my th ph id vn",
    "apj": "au nz sg jp in kr hk tw my th ph id vn",
    "asia": "in cn jp kr sg hk tw my th ph id vn ae sa il pk bd",
    "southeast asia": "sg my th ph id vn kh la mm",
    "anz": "au nz",
    "australia and new zealand": "au nz",
    "middle east": "ae sa il qa kw bh om jo lb tr",
    "mena": "ae sa il qa kw bh om jo lb eg ma tn dz",
    "gcc": "ae sa qa kw bh om",
    "africa": "za ng ke eg gh ma tz ug rw et sn ci",
    "nordics": "se no dk fi is",
    "scandinavia": "se no dk",
    "benelux": "nl be lu",
    "dach": "de at ch",
    "uki": "gb ie",
    "uk and ireland": "gb ie",
}
ABBREVIATED = (("saint", "st"), ("fort", "ft"), ("mount", "mt"), ("sainte", "ste"))
# Words that a place keeps its wrapping for, and what wraps a place.
GENERIC = frozenset("united free new central capital eastern western northern southern north south east west northeast northwest southeast southwest".split())
WRAPPED = re.compile(r"(?:greater )?(.+?)(?: (?:state|province|metro(?:politan)? area|metro|area))?")
METROS = {
    "delhi ncr": "delhi,new delhi,gurugram,gurgaon,noida,greater noida,faridabad,ghaziabad",
    "greater toronto area,gta": "toronto,mississauga,brampton,markham,vaughan,oakville,richmond hill",
    "bay area,san francisco bay area,sf bay area": "san francisco,oakland,san jose,palo alto,mountain view,sunnyvale,menlo park,redwood city,santa clara,berkeley,fremont,san mateo,cupertino",
}
METRO = {name: cities.split(",") for names, cities in METROS.items() for name in names.split(",")}
#: Cities of several spellings, English first: a parameter of tokens and of queries.
CITY_SPELLINGS = """munich munchen muenchen|cologne koln koeln|nuremberg nurnberg nuernberg|dusseldorf duesseldorf|vienna wien|zurich zuerich|geneva geneve genf|basel bale basle|bern berne
lucerne luzern|milan milano mailand|rome roma|turin torino|genoa genova genua|padua padova|seville sevilla|zaragoza saragossa|lisbon lisboa lissabon|porto oporto|brussels bruxelles brussel
antwerp antwerpen anvers|copenhagen kobenhavn|gothenburg goteborg|prague praha prag|warsaw warszawa|krakow cracow|bucharest bucuresti|athens athina|moscow moskva|kyiv kiev|tokyo tokio|beijing peking
busan pusan|mumbai bombay|kolkata calcutta|chennai madras|bengaluru bangalore|pune poona|kochi cochin|thiruvananthapuram trivandrum|vadodara baroda|yangon rangoon|algiers alger|bavaria bayern"""
SAME_CITY = {name: group.split() for group in CITY_SPELLINGS.replace("\n", "|").split("|") for name in group.split()}


def country_codes(term: str | None) -> tuple[str, ...]:
    """Codes of the country or region that the term names; none for a place. Two-letter codes of states name no country."""
    code = places.country_of(term)
    return (code,) if code else tuple(REGIONS.get(places.plain(term), "").split())


def us_state_code(place: str) -> str | None:
    return None if norm(place) == "montana" else places.STATE_NAMES.get(norm(place))


def place_spellings(place: str) -> list[str]:
    """The place as tokens have it: plain, without what wraps it, the cities of a metropolis, hyphens as spaces, saints and
    forts short and long, and other spellings of a city."""
    key = norm(place)
    out = [key, *METRO.get(key, [])]
    inner = WRAPPED.fullmatch(key)
    if key not in METRO and inner and inner[1] != key and inner[1] not in GENERIC:
        out += [inner[1], *METRO.get(inner[1], [])]
    out += [x.replace("-", " ") for x in out]
    for long, short in ABBREVIATED:
        for a, b in ((long, short), (short, long)):
            out += [re.sub(rf"^{a}\.? ", f"{b} ", x) for x in out if re.match(rf"{a}\.? ", x)]
    out += [y for x in out for y in SAME_CITY.get(x, [])]
    return list(dict.fromkeys(out))


def location_tokens(text: str | None) -> list[str]:
    """Segments of up to four words, words of two letters or more, and the other spellings of cities among them."""
    out: list[str] = []
    for part in re.split(r"[,/|]|\s+-\s+", norm(text)):
        segment = " ".join(re.findall(r"[a-z0-9']+", part))
        own = segment.split()
        out += [segment] * (0 < len(own) <= 4) + [w for w in own if len(w) > 1]
        out += [spelling for w in (segment, *own) for spelling in SAME_CITY.get(w, [])]
    return list(dict.fromkeys(out))


def per_value(fn: Callable, kind: str) -> Callable[[Column], Column]:
    """A column function that maps each value by fn, once for each different value of a batch."""

    def run(s: pd.Series) -> pd.Series:
        codes, different = pd.factorize(s, use_na_sentinel=False)
        told = pd.Series([fn(None if pd.isna(x) else x) for x in different], dtype=object)
        return told.take(codes).reset_index(drop=True)

    return lambda c: F.pandas_udf(run, kind)(c)


norm_udf = per_value(norm, "string")
tokens_udf = per_value(location_tokens, "array<string>")


def countries_udf(location: Column) -> Column:
    g = places.gazetteer()
    return per_value(lambda text: countries_in(text, g), "array<string>")(location)


def with_country(location: str | None, country: str | None, g: places.Gazetteer | None = None) -> str | None:
    """The location with the country added, if it then reads as exactly that country."""
    code = places.country_of(country, g)
    if not location or not code or countries_in(location, g) == [code]:
        return location
    longer = f"{location}, {country}"
    return longer if countries_in(longer, g) == [code] else location


def with_country_udf(location: Column, country: Column) -> Column:
    g = places.gazetteer()

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        held: dict = {}
        return pd.Series([held[k] if (k := (x, y)) in held else held.setdefault(k, with_country(x, y, g)) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(location, country)


def remote_region_countries(location: Column) -> Column:
    """Codes of the regions that a remote posting's location names."""
    none = F.array().cast("array<string>")
    out = none
    for pattern, codes in places.REMOTE_REGIONS:
        out = F.array_union(out, F.when(location.rlike(f"(?i){pattern}"), F.lit(codes.split())).otherwise(none))
    return out


def reads_anew(location: Column, countries: Column) -> Column:
    """Whether a stored row's shape is one that older readings got wrong: a dash head, a state or code at the end, a list."""
    shapes = r"(?:^|[,;|/]\s*)(?:USA?|CAN?)-[A-Za-z]{2}-|,\s*[A-Z]{2}(?:\s+\d{5})?\s*$|\b[A-Z]{3}\s*$|^[A-Z]{3}\s*-|[;|]"
    return location.rlike(shapes) | ((F.size(countries) == 0) & location.contains(","))
