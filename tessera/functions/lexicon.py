"""Word lists of the analyzers and rule tables that the expressions and their SQL twins share."""

from __future__ import annotations

# The stopword list and the short word lists decide which terms match, so they agree with the system this engine answers for.
STOPWORDS = tuple(
    """
    a about above after again against all almost already along another around also although am among an and any are as at
    be because before behind below beside besides between beyond both but by can co corp d do during
    each elsewhere etc even ever ex few for from further furthermore had have he hence her here hers herself him himself his how however
    i if in spite into it its itself just ll m may me meanwhile might moreover my myself neither no nor not now
    o of off on once only or other our ours ourselves out over overall own re s same several shall she so some such
    t than that the their theirs them themselves then there therefore these they this those through to too under until
    ve very via we what when where which while who whom why will with y yet you your yours yourself yourselves
    """.split()
)
#: Stems before n't that are expanded, and the irregular ones with their expansion.
NEGATED = ("are", "could", "do", "does", "did", "has", "have", "is", "must", "should", "would", "was", "were")
NEGATED_IRREGULAR = (("ai", "are"), ("ca", "can"), ("sha", "shall"), ("wo", "will"))
#: After these, 's is a verb.
PRONOUNS = ("he", "she", "it")
#: Contraction tails, marks that are tokens but not indexed.
TAILS = ("s", "ve", "ll", "m", "re", "d", "t")
MARKS = (".", "?", "!", "'")
# The tags' classes and the suffix trims, which decide which forms meet.
#: Part-of-speech tags whose words are lemmatised, and the lemma class.
TAG_CLASSES = {"NN": "n", "NNPS": "n", "NNS": "n", "VB": "v", "VBD": "v", "VBG": "v", "VBN": "v", "VBP": "v", "VBZ": "v", "JJ": "a", "JJR": "a", "JJS": "a", "RBR": "r", "RBS": "r"}
#: Suffix trims; every one that fits is tried, on words of four letters and more.
TRIMS = (("men", "man"), ("sses", "ss"), ("ies", "y"), ("ies", "ie"), ("ves", "ve"), ("ves", "f"), ("ves", "fe"), ("ces", "x"), ("es", ""), ("es", "is"), ("s", ""))

# Common irregular forms of general English (this engine's own choice).
_VERBS = {
    form: base
    for base, forms in {
        "be": "is are was were been being", "have": "has had having", "do": "does did done", "go": "went gone goes", "say": "said", "make": "made", "take": "took taken", "come": "came",
        "see": "saw seen", "know": "knew known", "get": "got gotten", "give": "gave given", "find": "found", "think": "thought", "tell": "told", "become": "became", "leave": "left",
        "feel": "felt", "bring": "brought", "begin": "began begun", "keep": "kept", "hold": "held", "write": "wrote written", "stand": "stood", "hear": "heard", "mean": "meant",
        "meet": "met", "run": "ran", "pay": "paid", "sit": "sat", "speak": "spoke spoken", "lead": "led", "grow": "grew grown", "lose": "lost", "fall": "fell fallen", "send": "sent",
        "build": "built", "understand": "understood", "draw": "drew drawn", "break": "broke broken", "spend": "spent", "rise": "rose risen", "drive": "drove driven", "buy": "bought",
        "wear": "wore worn", "choose": "chose chosen", "eat": "ate eaten", "teach": "taught", "sell": "sold", "catch": "caught", "fight": "fought", "sing": "sang sung", "win": "won",
        "throw": "threw thrown", "fly": "flew flown", "sleep": "slept", "steal": "stole stolen", "forget": "forgot forgotten", "swim": "swam swum", "drink": "drank drunk", "seek": "sought",
        "arise": "arose arisen", "awake": "awoke awoken", "beat": "beaten", "bend": "bent", "bite": "bit bitten", "bleed": "bled", "blow": "blew blown", "breed": "bred", "cling": "clung", "creep": "crept",
        "deal": "dealt", "dig": "dug", "feed": "fed", "flee": "fled", "fling": "flung", "forbid": "forbade forbidden", "forgive": "forgave forgiven", "freeze": "froze frozen", "hang": "hung", "hide": "hid hidden",
        "kneel": "knelt", "lay": "laid", "lend": "lent", "light": "lit", "ride": "rode ridden", "ring": "rang rung", "shake": "shook shaken", "shine": "shone", "shoot": "shot", "shrink": "shrank shrunk",
        "sink": "sank sunk", "slide": "slid", "spin": "spun", "spit": "spat", "spring": "sprang sprung", "stick": "stuck", "sting": "stung", "strike": "struck stricken", "string": "strung", "swear": "swore sworn",
        "sweep": "swept", "swing": "swung", "tear": "tore torn", "tread": "trod trodden", "wake": "woke woken", "weave": "wove woven", "weep": "wept", "slay": "slew slain", "dream": "dreamt", "burn": "burnt",
        "learn": "learnt", "leap": "leapt", "spell": "spelt", "spill": "spilt", "spoil": "spoilt", "show": "shown", "prove": "proven", "sew": "sewn", "sow": "sown", "mow": "mown",
    }.items()
    for form in forms.split()
}
#: Verbs that are made of a prefix and one of the above follow it: overtook, undone, rewritten.
_PREFIXED = {
    "over": "take come eat do see hear run throw sleep ride hang", "under": "go take write pay", "out": "do grow run sell shine bid", "re": "make do write build tell think pay read take sell draw grow",
    "un": "do wind bind freeze", "mis": "take lead understand spell deal give", "fore": "see go tell know", "with": "draw hold stand", "up": "hold set", "par": "take", "be": "hold get fall",
}
IRREGULAR_VERBS = _VERBS | {prefix + form: prefix + base for prefix, bases in _PREFIXED.items() for form, base in _VERBS.items() if base in bases.split()}
IRREGULAR_PLURALS = {
    plural: one
    for one, plural in {
        "child": "children", "foot": "feet", "goose": "geese", "louse": "lice", "mouse": "mice", "ox": "oxen", "person": "people", "tooth": "teeth", "man": "men", "woman": "women", "criterion": "criteria",
        "phenomenon": "phenomena", "datum": "data", "index": "indices", "matrix": "matrices", "vertex": "vertices", "analysis": "analyses", "thesis": "theses", "crisis": "crises", "axis": "axes", "knife": "knives",
        "life": "lives", "wife": "wives", "leaf": "leaves", "wolf": "wolves", "half": "halves", "loaf": "loaves", "shelf": "shelves", "self": "selves", "thief": "thieves", "calf": "calves", "scarf": "scarves",
        "elf": "elves", "hoof": "hooves", "cactus": "cacti", "fungus": "fungi", "nucleus": "nuclei", "radius": "radii", "stimulus": "stimuli", "bacterium": "bacteria", "stratum": "strata", "medium": "media",
        "memorandum": "memoranda", "hypothesis": "hypotheses", "diagnosis": "diagnoses", "oasis": "oases", "parenthesis": "parentheses", "appendix": "appendices", "die": "dice", "formula": "formulae", "larva": "larvae",
    }.items()
}
#: A plural's ending comes off without a look at the vocabulary; the first pattern that fits decides, and an empty result means none. Java and RE2 read the patterns alike.
S_RULES = ((r"^.{1,3}$", ""), (r"^(speci|abdo|regi|acu|albu|sta|ra|a|o|ye|hy)men$", ""), (r"^(.+)men$", r"\1man"), (r"(ss|us|is)$", ""), (r"^(.+)ies$", r"\1y"), (r"^(.+(s|x|z|ch|sh))es$", r"\1"), (r"^(.+)s$", r"\1"))
#: Of -ed and -ing words these bases are tried in order, then those of -er and -est words; the first that the vocabulary has is the lemma. An -ing word has six letters at least, but for the three in -ying.
VERB_BASES = ((r"^(.{2,}ed|.{3,}ing)$", r"^(.*)(ed|ing)$", r"\1"), (r"^(.{3,}ed|.{3,}ing)$", r"^(.+)([b-df-hj-np-tv-z])[b-df-hj-np-tv-z](ed|ing)$", r"\1\2"), (r"^(.{2,}ed|.{3,}ing)$", r"^(.*)(ed|ing)$", r"\1e"), (r"^(d|l|t)ying$", r"^(d|l|t)ying$", r"\1ie"))
COMPARATIVE_BASES = ((r"^.{3,}(er|est)$", r"^(.*)(er|est)$", r"\1"), (r"^.{3,}(er|est)$", r"^(.*)(er|est)$", r"\1e"), (r"^.{2,}i(er|est)$", r"^(.*)i(er|est)$", r"\1y"))
