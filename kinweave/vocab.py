"""Word lists, weights and tables that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Tokens that say nothing about which organisation a name means.
IGNORABLE = "inc incorporated corp corporation co company companies corporations groups firms ltd limited llc plc sa ag gmbh pbc holdings group technologies technology labs lab ai research foundation the of and de la le les el".split()

# Letters and what they fold to (besides ß, which folds to ss).
FOLD = {
    "áàâäãåā": "a", "ÁÀÂÄÃÅĀ": "A", "éèêëēě": "e", "ÉÈÊËĒĚ": "E", "íìîïī": "i", "ÍÌÎÏĪ": "I", "óòôöõøō": "o", "ÓÒÔÖÕØŌ": "O", "úùûüūů": "u", "ÚÙÛÜŪŮ": "U", "ñň": "n", "ÑŇ": "N",
    "çćč": "c", "ÇĆČ": "C", "ł": "l", "Ł": "L", "żźž": "z", "ŻŹŽ": "Z", "şš": "s", "ŞŠ": "S", "ğ": "g", "Ğ": "G", "ýÿ": "y", "Ý": "Y", "ř": "r", "Ř": "R", "ď": "d", "Ď": "D", "ť": "t", "Ť": "T",
}

# Fixed values of the name gate.
LEADING_DETERMINERS = "a an the one another some this that these those its their his her our your several many other".split()
CLAUSE_MARKERS = [" which ", " that ", " who ", " whose ", ", another", " such as ", " including ", " according ", " said ", " says "]
CONNECTORS = "of and the for in on at by & de la le du del di da von van y e to".split()
GENERIC_SINGLE = (
    "officials official agencies agency company companies government governments spokesperson spokesman spokeswoman department departments court courts judge police regulators regulator investors investor "
    "employees employee customers users people president ceo cto cfo coo chairman director founder founders executives executive researchers authorities lawmakers prosecutors defendants plaintiffs startup "
    "startups firm firms bank banks state city country nation military administration committee board team group sources reporters media press"
).split()
LEADING_WORDS = "and or the a an of at in by".split()

# Fixed values of grounding: words that a relation of a family needs near its names, and constraints on types.
PROXIMITY = 400
CUES: list[tuple[str, list[str]]] = [
    ("acquired acquired_by merged_with", ["acqui", "buy", "bought", "purchas", "takeover", "merg", "deal to", "sold to"]),
    ("ceo_of", ["ceo", "chief executive"]),
    ("cfo_of", ["cfo", "chief financial"]),
    ("cto_of", ["cto", "chief technology", "chief technical"]),
    ("chairman_of chair_of", ["chair"]),
    ("founder_of cofounder_of co_founder_of", ["found", "started", "created"]),
    ("suing sued_by sues lawsuit_against", ["sue", "suit", "litigat", "court", "complaint", "legal action", "plaintiff", "defendant"]),
    ("invested_in investor_in funded funded_by backed_by", ["invest", "fund", "raised", "round", "backed", "stake", "capital", "valuation"]),
    ("partner_of partnered_with partners_with", ["partner", "collaborat", "team up", "teamed up", "alliance", "agreement", "deal", "joint"]),
    ("headquartered_in based_in", ["headquart", "based", "hq", "offices"]),
    ("competes_with competitor_of rival_of", ["compet", "rival"]),
    ("launched launches", ["launch", "releas", "unveil", "introduc", "announc"]),
    ("indicted charged sanctioned fined", ["indict", "charg", "sanction", "fine", "penalt", "settle", "plead", "convict"]),
]
CUES_OF = {relation: words for relations, words in CUES for relation in relations.split()}
SAME_SENTENCE = ["acquired", "acquired_by", "merged_with", "suing", "sued_by"]
ROLE_RELATIONS = "ceo_of cfo_of cto_of chairman_of chair_of founder_of cofounder_of co_founder_of employed_by works_at member_of".split()
NO_PERSON_OBJECT = "acquired acquired_by merged_with invested_in headquartered_in based_in ceo_of cfo_of cto_of chairman_of founder_of".split()
DEALS = ["acquired", "acquired_by", "merged_with", "invested_in"]
PLACED = ["headquartered_in", "based_in", "located_in"]

# Parts of words in a question, and the relations they ask for.
INTENTS: list[tuple[list[str], list[str]]] = [
    ("lawsuit sue sued suing litigation court dispute regulat fine charge indict sanction".split(), "suing sued_by indicted charged sanctioned fined investigated regulated_by".split()),
    ("acqui bought merger merged takeover".split(), "acquired acquired_by merged_with".split()),
    ("fund invest raised round valuation backer".split(), "invested_in investor_in funded funded_by backed_by".split()),
    ("lead leads ceo chief founder run runs head executive board".split(), "ceo_of cfo_of cto_of chairman_of founder_of cofounder_of president_of board_member_of member_of".split()),
    ("partner alliance collaborat".split(), "partner_of partnered_with working_with".split()),
    ("launch release product unveil".split(), "launched launches released owned_by".split()),
    ("compet rival".split(), "competes_with competitor_of".split()),
    ("headquarter based located where".split(), "headquartered_in based_in located_in".split()),
    ("employ hired joined left moved role job".split(), "employed_by works_at joined left resigned_from hired_by ceo_of founder_of".split()),
]

# Relations of which only one may hold at a time (per subject, per object), and what a digest escalates.
EXCLUSIVE = {"ceo_of": (True, True), "cfo_of": (True, True), "cto_of": (True, True), "coo_of": (True, True), "chairman_of": (True, True), "president_of": (True, True), "headquartered_in": (True, False), "based_in": (True, False), "owned_by": (True, False), "acquired_by": (True, False), "parent_of": (False, True)}
ESCALATE_TYPES = "suing sued_by acquired acquired_by merged_with ceo_of cfo_of resigned_from fired indicted charged sanctioned banned hacked breached".split()
ESCALATE_WEIGHT, ESCALATE_MAGNITUDE = 2.0, 6.0

# Other names of countries.
COUNTRY_SYNONYMS = {
    "us": "united states", "usa": "united states", "u s": "united states", "u s a": "united states", "united states of america": "united states", "america": "united states",
    "uk": "united kingdom", "u k": "united kingdom", "britain": "united kingdom", "great britain": "united kingdom", "uae": "united arab emirates", "u a e": "united arab emirates",
    "russia": "russia", "south korea": "south korea", "korea": "south korea", "north korea": "north korea", "czechia": "czechia", "czech republic": "czechia", "holland": "netherlands", "the netherlands": "netherlands",
}

# Fixed values of page text: containers that go, tags that end a line, entities in the order they are decoded.
CONTAINERS = "script style noscript svg nav header footer aside".split()
BLOCK_TAGS = "p div br li h1 h2 h3 h4 tr section article blockquote".split()
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&mdash;", "—"), ("&ndash;", "–"), ("&lt;", "<"), ("&gt;", ">")]
LEAST_BLOCK = 80

SUPPORTED_STATUS = ["auto_merged", "resolved", "confirmed"]
LIVE_DAYS = 30
EARTH_RADIUS_KM = 6371.0
QUAKE_FEEDS = "all_hour all_day 1.0_day 2.5_day 4.5_day 2.5_week 4.5_week significant_month".split()


@dataclass(frozen=True)
class Weights:
    """Evidence weights by level of each feature; only upper and lower are meant to be tuned per run."""

    name: tuple = (-3.0, -0.5, 2.5, 4.5)
    alias_exact: float = 3.0
    jaccard: tuple = (-1.0, 1.0, 2.0)
    phonetic: tuple = (-0.5, 0.5, 1.0)
    type_agree: tuple = (-6.0, -1.5, 0.0, 1.0)
    extra_tokens: tuple = (0.0, -1.5, -2.5)
    token_subset: tuple = (0.0, 1.0, 2.5)
    acronym_match: float = 6.0
    acronym_mismatch: float = -3.0
    cooc: tuple = (0.0, 1.5, 2.5)
    corroboration: tuple = (0.0, 0.3, 0.7, 1.0)
    recent: float = 0.3
    prior_cap: float = 2.0
    upper: float = field(default=5.0)
    lower: float = field(default=1.0)
