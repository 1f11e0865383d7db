"""Fixed values.

These word lists, tables and constants must be equal to the ones results are compared with,
so they are stated here as plain text. They serve content moderation: the lists name the terms
a review tool has to find. Everything here is a default; every operator takes its own lists.
"""

from __future__ import annotations

# Extra exact terms, English and Spanish.
EXTRA_TERMS_EN = tuple(
    """
    ho hoe hoes skank skanks nigga niggas niggaz nigguh nukka nikka bish thot thots thottie thotties
    mofo mothafucka mothafuckas mothafuckin muthafucka muthafuckas muthafuckin coochie coochies
    puchi biatch biotch beyotch azz shyt fck effin dayum fucc fucck bytch shiet
    """.split()
)
EXTRA_TERMS_ES = tuple(
    """
    puta putas puto putos putada putona puteria hijueputa jueputa hijodeputa hijaputa hijaeputa
    hijoeputa joputa putamadre mierda mierdas comemierda cagon cagona chingar chinga chingada
    chingado chingados chingadera chingon chingona chingando cabron cabrones cabrona cabronas
    pendejo pendejos pendeja pendejas verga vergas vergon vergacion careverga culo culos culero
    culera culear culiar culiao culiado culeado culeao lameculo lameculos cojon cojones cojudo
    huevon huevona huevonada huevada guevon guevona mamaguevo mamagueva ahuevado aguevado aweonao
    ahueonao cono conazo concha conchetumadre conchatumare conchesumare chocha cuca panocha toto
    totona cajeta pinga pija picha polla monda caremonda bicho vicho choto coger follar follada
    singar zingar chichar maricon maricones marica marico mariconazo joto pato cacorro tortillera
    joder jodido jodida jodete jodiendo nojoda mamada mamadas mamon mamao mamavicho malparido
    malparida gonorrea pinche carajo carajos ojete pelotudo pelotuda forro gilipollas capullo
    desgraciado desgraciada bellaco bellaca bellaqueo bellaquear puneta arrecho arrecha cuero
    bichiyal tecato
    """.split()
)

# Roots for approximate matching, in priority order.
STYLE_ROOTS = tuple(
    """
    fuck fucker fuckers fucking fuckin motherfucker motherfucking shit bullshit bitch bitches
    nigga niggas nigger niggers cunt pussy whore faggot asshole
    """.split()
)
# Roots for masked spellings, in priority order.
WILDCARD_ROOTS = STYLE_ROOTS + tuple(
    "ass dick dicks cock damn dammit goddamn bastard slut sluts hoes".split()
)

# Tokens that never match.
ALLOWLIST = tuple("dame damo woody dummy god lord hell fat slave slaves panty opium".split())

# Two-word compounds, and the filler words allowed between their halves.
COMPOUNDS = (
    ("mother", "fucker"), ("mother", "fuckers"), ("mother", "fuckin"), ("mother", "fucking"), ("mother", "fucka"), ("mother", "fuckas"),
    ("bull", "shit"), ("horse", "shit"), ("bat", "shit"), ("dip", "shit"), ("god", "damn"), ("god", "dammit"), ("god", "damit"),
    ("jack", "ass"), ("dumb", "ass"), ("bad", "ass"), ("kick", "ass"), ("smart", "ass"), ("fat", "ass"),
    ("cock", "sucker"), ("cock", "suckers"), ("cock", "sucking"), ("dick", "head"), ("dick", "heads"),
)
COMPOUNDS_ES = (
    ("hijo", "puta"), ("hija", "puta"), ("puta", "madre"), ("puto", "madre"), ("come", "mierda"), ("mama", "guevo"), ("mama", "gueva"), ("mama", "vicho"), ("mama", "bicho"),
    ("lame", "culo"), ("chupa", "pinga"), ("chupa", "pija"), ("chupa", "pollas"), ("cara", "verga"), ("care", "monda"), ("care", "chimba"), ("concha", "madre"), ("conche", "madre"),
)
GAP_WORDS = tuple("de of a la tu".split())

# The short list of the text highlighter.
HIGHLIGHT_TERMS = tuple(
    """
    fuck fuckin fucking shit bitch ass damn hell nigga niggas niggaz ho hoe hoes hos thot thots
    cunt pussy dick cock bastard
    """.split()
)

# Detection thresholds.
FUZZY_MIN = 90.0
STYLE_MIN_LEN = 4
WILDCARD_MIN_LEN = 3
JOINED_MIN_LEN = 3

# Sources whose times are estimates.
SYNTHETIC_SOURCES = ("lyrics", "lyrics_gap")
ESTIMATED_SOURCES = ("lyrics", "lyrics_gap", "hook_echo", "acoustic_echo")
CENSOR_CYCLE = ("mute", "beep", "reverse", "tape_stop")

# Languages written in Latin script, and the language decision thresholds.
LATIN_LANGUAGES = tuple(
    "en es fr de it pt nl pl tr ro ca sv da no fi cs hr hu sk sl id ms vi sw tl af".split()
)
LANGUAGE_MIN_P = 0.6
LATIN_MIN_RATIO = 0.85

# Channel counts by layout name, and bits by floating sample format.
CHANNEL_LAYOUTS = {
    "mono": 1, "stereo": 2, "2.1": 3, "3.0": 3, "4.0": 4, "quad": 4, "5.0": 5,
    "5.1": 6, "5.1(side)": 6, "5.1(back)": 6, "6.1": 7, "7.1": 8, "7.1(wide)": 8,
}
FLOAT_FORMAT_BITS = {"flt": 32, "fltp": 32, "dbl": 64, "dblp": 64}

# Subscription statuses, best first, and the ones that are billed.
STATUS_PRIORITY = tuple(
    "active trialing past_due unpaid paused incomplete canceled incomplete_expired".split()
)
BILLABLE_STATUSES = tuple("active trialing past_due unpaid".split())
FREE_LIMIT = 2
METRIC_FIELDS = ("songsImported", "songsReady")

# Tag containers by file extension, and keys that go stale.
CONTAINERS = {
    "mp3": "id3", "aiff": "id3", "aif": "id3", "wav": "id3",
    "flac": "flac", "m4a": "mp4", "mp4": "mp4",
}
STALE_TAG_KEYS = ("tlen",)
DJ_TAG_MARKERS = ("serato", "traktor", "native-instruments", "mixedinkey", "mixed in key", "rekordbox")
AUDIO_EXTENSIONS = ("mp3", "wav", "flac", "aiff", "aif", "ogg", "m4a")

# Version words dropped from titles.
VERSION_WORDS = tuple(
    """
    intro outro edit remix deluxe clean dirty explicit radio extended original remaster remastered
    acoustic live demo instrumental version skit interlude bonus album single prod shot
    """.split()
)
# Where a credit string is cut, tried in this order.
ARTIST_DELIMITERS = (",", " & ", " and ", " ft.", " ft ", " feat.", " feat ", " featuring ")

# Junk in scraped titles, as parts of one pattern: endings of site names, marks, captions and quality tags.
SITE_ENDINGS = ("com", "net", "org", "io", "cc", "co", "me", "to", "xyz")
JUNK_MARKS = "®™©"
JUNK_CAPTIONS = (r"official\s+(?:music\s+)?(?:video|audio|visualizer)", r"lyrics?\s*(?:video)?")
QUALITY_TAGS = ("hd", "hq", "4k", r"320\s*kbps", r"128\s*kbps", "mp3", "flac")
JUNK_OFFERS = (r"free\s+download",)
JUNK = "|".join(
    (
        rf"\b\S+\.(?:{'|'.join(SITE_ENDINGS)})\b",
        f"[{JUNK_MARKS}]",
        *(rf"\b{c}\b" for c in JUNK_CAPTIONS),
        rf"\b(?:{'|'.join(QUALITY_TAGS)})\b",
        *(rf"\b{c}\b" for c in JUNK_OFFERS),
    )
)
