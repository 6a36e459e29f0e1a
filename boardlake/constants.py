"""Fixed values that results depend on."""

#: Freshness window in hours: default and bounds.
WINDOW_H, WINDOW_MIN_H, WINDOW_MAX_H = 24, 24, 168
DAY = 86_400
#: Hidden postings are kept for so many days.
RETENTION_DAYS = 30
#: BM25 parameters and the weights of a posting's fields.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"position_name": 3.0, "company_name": 0.5, "job_description": 1.0}
#: Words that nearly every posting has and that say nothing in a search.
CORPUS_STOPWORDS = """
the and for with you your our are will that this have has from not but all can who was were been their them they its it's into out
about over under more most other such than then there these those some any each how what when where which while would should could
may might must job jobs role roles position positions work working years year experience ability able including include includes
required require requirements preferred responsibilities qualifications skills candidate candidates applicant applicants apply
application employer employment company companies team teams new high strong well also one two three per via etc inc llc
opportunity equal benefits salary full time part day days week month please resume email phone name address city state www http
https com org net
""".split()
#: Codes and names of states, used for locations of the form "City, ST".
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska",
    "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
#: Codes and names of countries by region; more names of some below.
_BY_REGION = {
    "AMER": {
        "US": "United States", "CA": "Canada", "MX": "Mexico", "BR": "Brazil", "AR": "Argentina", "CL": "Chile", "CO": "Colombia", "PE": "Peru",
        "VE": "Venezuela", "EC": "Ecuador", "BO": "Bolivia", "PY": "Paraguay", "UY": "Uruguay", "CR": "Costa Rica", "PA": "Panama", "GT": "Guatemala",
        "HN": "Honduras", "SV": "El Salvador", "NI": "Nicaragua", "BZ": "Belize", "CU": "Cuba", "DO": "Dominican Republic", "HT": "Haiti",
        "JM": "Jamaica", "TT": "Trinidad and Tobago", "BS": "Bahamas", "BB": "Barbados", "GY": "Guyana", "SR": "Suriname", "PR": "Puerto Rico",
    },
    "EMEA": {
        "GB": "United Kingdom", "IE": "Ireland", "FR": "France", "DE": "Germany", "ES": "Spain", "PT": "Portugal", "IT": "Italy", "NL": "Netherlands",
        "BE": "Belgium", "LU": "Luxembourg", "CH": "Switzerland", "AT": "Austria", "PL": "Poland", "CZ": "Czech Republic", "SK": "Slovakia",
        "HU": "Hungary", "RO": "Romania", "BG": "Bulgaria", "GR": "Greece", "HR": "Croatia", "SI": "Slovenia", "RS": "Serbia",
        "BA": "Bosnia and Herzegovina", "ME": "Montenegro", "MK": "North Macedonia", "AL": "Albania", "DK": "Denmark", "SE": "Sweden", "NO": "Norway",
        "FI": "Finland", "IS": "Iceland", "EE": "Estonia", "LV": "Latvia", "LT": "Lithuania", "UA": "Ukraine", "BY": "Belarus", "MD": "Moldova",
        "RU": "Russia", "TR": "Turkey", "CY": "Cyprus", "MT": "Malta", "IL": "Israel", "JO": "Jordan", "LB": "Lebanon", "SA": "Saudi Arabia",
        "AE": "United Arab Emirates", "QA": "Qatar", "KW": "Kuwait", "BH": "Bahrain", "OM": "Oman", "YE": "Yemen", "IQ": "Iraq", "IR": "Iran",
        "SY": "Syria", "EG": "Egypt", "MA": "Morocco", "DZ": "Algeria", "TN": "Tunisia", "LY": "Libya", "SD": "Sudan", "ET": "Ethiopia",
        "KE": "Kenya", "UG": "Uganda", "TZ": "Tanzania", "RW": "Rwanda", "NG": "Nigeria", "GH": "Ghana", "CI": "Ivory Coast", "SN": "Senegal",
        "ML": "Mali", "CM": "Cameroon", "CD": "Democratic Republic of the Congo", "AO": "Angola", "ZM": "Zambia", "ZW": "Zimbabwe", "BW": "Botswana",
        "NA": "Namibia", "MZ": "Mozambique", "MG": "Madagascar", "MU": "Mauritius", "ZA": "South Africa",
    },
    "APAC": {
        "AU": "Australia", "NZ": "New Zealand", "CN": "China", "HK": "Hong Kong", "MO": "Macau", "TW": "Taiwan", "JP": "Japan", "KR": "South Korea",
        "KP": "North Korea", "IN": "India", "PK": "Pakistan", "BD": "Bangladesh", "LK": "Sri Lanka", "NP": "Nepal", "BT": "Bhutan", "MV": "Maldives",
        "TH": "Thailand", "VN": "Vietnam", "MY": "Malaysia", "SG": "Singapore", "ID": "Indonesia", "PH": "Philippines", "KH": "Cambodia",
        "LA": "Laos", "MM": "Myanmar", "BN": "Brunei", "MN": "Mongolia", "FJ": "Fiji", "PG": "Papua New Guinea", "AF": "Afghanistan",
        "KZ": "Kazakhstan", "UZ": "Uzbekistan",
    },
}
COUNTRY_REGIONS = {code: region for region, names in _BY_REGION.items() for code in names}
COUNTRY_NAMES = {code: name for names in _BY_REGION.values() for code, name in names.items()}
#: Country names that end a location, and their codes.
COUNTRIES = {name.lower(): code for code, name in COUNTRY_NAMES.items()} | {
    "uk": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "united states of america": "US", "usa": "US", "us": "US", "u s a": "US", "holland": "NL",
    "nederland": "NL", "the netherlands": "NL", "deutschland": "DE", "espana": "ES", "brasil": "BR", "czechia": "CZ", "korea": "KR", "republic of korea": "KR", "viet nam": "VN",
    "uae": "AE", "russian federation": "RU", "turkiye": "TR", "schweiz": "CH", "italia": "IT", "polska": "PL", "belgique": "BE", "osterreich": "AT", "sverige": "SE", "norge": "NO", "danmark": "DK",
}
#: What the extract's country is told by, in order, and the country.
EXTRACT_COUNTRIES = {
    "united states": "United States", "u.s.": "United States", "u.s.a.": "United States", "usa": "United States", "canada": "Canada", "united kingdom": "United Kingdom", "uk": "United Kingdom",
    "great britain": "United Kingdom", "australia": "Australia", "new zealand": "New Zealand", "germany": "Germany", "france": "France", "spain": "Spain", "italy": "Italy", "ireland": "Ireland",
    "india": "India", "singapore": "Singapore", "japan": "Japan", "mexico": "Mexico", "brazil": "Brazil", "netherlands": "Netherlands", "belgium": "Belgium", "sweden": "Sweden", "norway": "Norway",
    "denmark": "Denmark", "finland": "Finland", "switzerland": "Switzerland", "poland": "Poland", "austria": "Austria", "portugal": "Portugal", "south africa": "South Africa",
}
#: Words of a location that are no town.
NO_TOWNS = """remote;hybrid;onsite;on site;work from home;wfh;flexible;anywhere;worldwide;global;international;united states;usa;us;amer;americas;north america;south america;latin america;latam;
emea;europe;middle east;africa;apac;asia;asia pacific;oceania;various;multiple locations;other;not specified;tbd;n a;undefined;null""".replace("\n", "").split(";")
