"""Where a posting's job is: a verdict on each part of its location text, below structured countries."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import full_match, matches, strip

# The states of the United States with their codes.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine",
    "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
# The member states of the United Nations by their common English names, but the United States and Georgia, and some other names of countries and regions.
COUNTRIES = [
    "Afghanistan", "Albania", "Algeria", "Andorra", "Angola", "Antigua and Barbuda", "Argentina", "Armenia", "Australia", "Austria", "Azerbaijan", "Bahamas", "Bahrain", "Bangladesh", "Barbados",
    "Belarus", "Belgium", "Belize", "Benin", "Bhutan", "Bolivia", "Bosnia and Herzegovina", "Botswana", "Brazil", "Brunei", "Bulgaria", "Burkina Faso", "Burundi", "Cambodia", "Cameroon", "Canada",
    "Cape Verde", "Central African Republic", "Chad", "Chile", "China", "Colombia", "Comoros", "Congo", "Costa Rica", "Croatia", "Cuba", "Cyprus", "Czech Republic", "Denmark", "Djibouti", "Dominica",
    "Dominican Republic", "Ecuador", "Egypt", "El Salvador", "Equatorial Guinea", "Eritrea", "Estonia", "Eswatini", "Ethiopia", "Fiji", "Finland", "France", "Gabon", "Gambia", "Germany", "Ghana",
    "Greece", "Grenada", "Guatemala", "Guinea", "Guyana", "Haiti", "Honduras", "Hungary", "Iceland", "India", "Indonesia", "Iran", "Iraq", "Ireland", "Israel", "Italy", "Ivory Coast", "Jamaica",
    "Japan", "Jordan", "Kazakhstan", "Kenya", "Kiribati", "Kuwait", "Kyrgyzstan", "Laos", "Latvia", "Lebanon", "Lesotho", "Liberia", "Libya", "Liechtenstein", "Lithuania", "Luxembourg", "Madagascar",
    "Malawi", "Malaysia", "Maldives", "Mali", "Malta", "Mauritania", "Mauritius", "Mexico", "Moldova", "Monaco", "Mongolia", "Montenegro", "Morocco", "Mozambique", "Myanmar", "Namibia", "Nepal",
    "Netherlands", "New Zealand", "Nicaragua", "Niger", "Nigeria", "North Korea", "North Macedonia", "Norway", "Oman", "Pakistan", "Panama", "Papua New Guinea", "Paraguay", "Peru", "Philippines",
    "Poland", "Portugal", "Qatar", "Romania", "Russia", "Rwanda", "Saudi Arabia", "Senegal", "Serbia", "Seychelles", "Sierra Leone", "Singapore", "Slovakia", "Slovenia", "Somalia", "South Africa",
    "South Korea", "South Sudan", "Spain", "Sri Lanka", "Sudan", "Suriname", "Sweden", "Switzerland", "Syria", "Tajikistan", "Tanzania", "Thailand", "Togo", "Tunisia", "Turkey", "Turkmenistan",
    "Uganda", "Ukraine", "United Arab Emirates", "United Kingdom", "Uruguay", "Uzbekistan", "Venezuela", "Vietnam", "Yemen", "Zambia", "Zimbabwe",
]
REGIONS = ["UK", "Great Britain", "England", "Scotland", "Wales", "Northern Ireland", "Czechia", "Hong Kong", "Taiwan", "Korea", "Panamá", "México", "UAE", "Europe", "EMEA", "APAC", "LATAM", "European Union"]
# Cities and provinces abroad that stand in postings without their country.
PLACES = {
    "Canada": ["Toronto", "Vancouver", "Montreal", "Montréal", "Ottawa", "Calgary", "Ontario, Canada", "British Columbia", "Quebec"],
    "Europe": ["London", "Dublin", "Paris, France", "Berlin", "Munich", "Madrid", "Barcelona", "Lisbon", "Amsterdam", "Zurich", "Zürich", "Stockholm", "Copenhagen", "Warsaw", "Kraków", "Krakow", "Bucharest", "Prague", "Budapest"],
    "Caucasus": ["Tbilisi", "Batumi", "Kutaisi"],
    "India": ["Bangalore", "Bengaluru", "Chennai", "Delhi", "Gurgaon", "Gurugram", "Haryana", "Hyderabad", "Karnataka", "Karnātaka", "Kolkata", "Maharashtra", "Mumbai", "Noida", "Pune", "Tamil Nadu", "Telangana", "Uttar Pradesh"],
    "Asia and Pacific": ["Tokyo", "Osaka", "Seoul", "Beijing", "Shanghai", "Shenzhen", "Taipei", "Sydney, Australia", "Tel Aviv"],
    "America": ["Bogotá", "Bogota", "Buenos Aires", "São Paulo", "Sao Paulo", "Guadalajara"],
}
#: Towns of the United States that bear a name from abroad: they are those towns if a state follows.
NAMESAKES = ["Athens", "Berlin", "Brazil", "Cambridge", "China", "Cuba", "Delhi", "Dublin", "Florence", "Geneva", "Lebanon", "London", "Manchester", "Melbourne", "Mexico", "Moscow", "New London", "Norway", "Oxford", "Panama City", "Paris", "Peru", "Poland", "Rome", "Sweden", "Vancouver", "Warsaw"]
COUNTRY_CODES = ("US", "USA", "UNITEDSTATES", "UNITEDSTATESOFAMERICA")
SEPARATOR = r"(?U)\s*[|;]\s*"


def any_of(names: list[str]) -> str:
    return "(?:" + "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in sorted(names, key=lambda n: (-len(n), n))) + ")"


CODE, STATE = any_of(list(STATES)), any_of(list(STATES.values()))
NATION = r"(?:United\s+States(?:\s+of\s+America)?|USA|U\.S\.A?\.?|US)"
ABROAD = rf"(?<!New )\b{any_of([*COUNTRIES, *REGIONS, *(p for own in PLACES.values() for p in own)])}\b"
TOWN = rf"\s*{any_of(NAMESAKES)}\s*,\s*(?:{CODE}|{STATE})(?:\s*,\s*{NATION})?\s*"
PLACE_OF_WORK = r"(?:remote|hybrid|on-?\s?site)"
TAIL = rf"\s*[-,/(]?\s*{PLACE_OF_WORK}\s*\)?\s*$"
#: "Remote, CA" may be a state or a country.
DOUBTFUL = r"\s*remote\s*[-,/]?\s*[A-Z]{2}\s*"


def verdict(part: Column) -> Column:
    """us, abroad or null for one place: a nation's own name first, then names from abroad, then states and their codes in capitals."""
    town = full_match(F.regexp_replace(part, "(?iUd)" + TAIL, ""), TOWN)
    state = matches(part, rf"\b{STATE}\b") | (matches(part, rf"\b{CODE}\b", cased=True) & ~full_match(part, DOUBTFUL))
    return F.when(town | matches(part, rf"(?<!\w){NATION}(?!\w)"), "us").when(matches(part, ABROAD), "abroad").when(state, "us")


def location_status(location: Column, workplace: Column, countries: Column, default_country: Column) -> Column:
    """us, non_us, us_inferred_remote or unknown.

    Structured countries decide alone. Otherwise any part (parts are set off by | or ;) in the United States wins over parts
    abroad; a bare "remote" takes the feed's default country.
    """
    codes = F.transform(countries, lambda c: F.regexp_replace(F.upper(c), "[^A-Z]", ""))
    text = strip(F.coalesce(location, F.lit("")))
    whole = strip(F.concat_ws(" ", text, F.coalesce(workplace, F.lit(""))))
    # The workplace belongs to the last part only; it must not turn "Remote, CA" into a state.
    parts = F.transform(F.filter(F.split(F.when(full_match(text, DOUBTFUL), text).otherwise(whole), SEPARATOR), lambda s: s != ""), verdict)
    named = reduce(or_, [F.array_contains(codes, c) for c in COUNTRY_CODES])
    return (
        F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, F.when(named, "us").otherwise("non_us"))
        .when(F.array_contains(F.coalesce(F.array_compact(parts), F.array().cast("array<string>")), "us"), "us")
        .when(F.array_contains(F.array_compact(parts), "abroad"), "non_us")
        .when(full_match(text, "remote") & F.upper(F.coalesce(default_country, F.lit(""))).isin("US", "USA"), "us_inferred_remote")
        .otherwise("unknown")
    )
