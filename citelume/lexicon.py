"""Word lists and patterns the engine looks for, as values that can be swapped."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

Terms = tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class Lexicon:
    """Each list in order: (name, patterns or phrases)."""

    defects: Terms
    processes: Terms
    parameters: Terms
    materials: Terms
    roles: Terms
    sections: Terms
    aliases: Terms
    mechanisms: Terms
    reference_sections: tuple[str, ...]
    reference_like: tuple[str, ...]
    background: tuple[str, ...]
    explanatory: str
    experimental: str
    review: str
    # cues in text for signals, (cues, roles)
    mitigation: tuple[tuple[str, ...], tuple[str, ...]]
    experiment: tuple[tuple[str, ...], tuple[str, ...]]
    mechanism: tuple[tuple[str, ...], tuple[str, ...]]
    relations: tuple[str, ...]
    # cues for the best sentence
    strategy_cues: tuple[str, ...]
    mechanism_cues: tuple[str, ...]
    recommendation_cues: tuple[str, ...]
    outcome_cues: tuple[str, ...]
    effect_cues: tuple[str, ...]
    direct_roles: tuple[str, ...] = ("mitigation", "result", "recommendation")
    causal_roles: tuple[str, ...] = ("cause", "mechanism")
    mode: str = "compat"

    def with_mode(self, mode: str) -> Lexicon:
        """compat: variants are patterns found anywhere; word_boundary: whole words only, plain variants taken literally."""
        if mode not in ("compat", "word_boundary"):
            raise ValueError(mode)
        return replace(self, mode=mode)

    def patterns(self, terms: Terms) -> Terms:
        if self.mode == "compat":
            return terms
        bound = lambda v: v if v.startswith(r"\b") else rf"(?<![a-z0-9]){re.escape(v)}(?![a-z0-9])"
        return tuple((name, tuple(map(bound, variants))) for name, variants in terms)


# fixed values: the lists below decide results
SCIENTIFIC = Lexicon(
    defects=(
        ("porosity", ("porosity", "gas porosity", "pore formation", "pores", "voids")),
        ("crack", ("crack", "cracking", "hot cracking", "cold cracking", "solidification cracking")),
        ("lack of fusion", ("lack of fusion", "incomplete fusion", "poor fusion")),
        ("undercut", ("undercut", "edge groove")),
        ("humping", ("humping", "bead humping", "hump formation")),
        ("spatter", ("spatter", "droplet spatter")),
        ("lack of penetration", ("lack of penetration", "incomplete penetration")),
        ("distortion", ("distortion", "warping", "residual distortion")),
    ),
    processes=(
        ("waam", ("waam", "wire arc additive manufacturing", "wire + arc additive manufacturing")),
        ("gmaw", ("gmaw", "gas metal arc welding", "mig", "mig welding", "cmt")),
        ("gtaw", ("gtaw", "gas tungsten arc welding", "tig", "tig welding")),
        ("arc_am", ("arc additive manufacturing", "welding additive manufacturing")),
    ),
    parameters=(
        ("current", (r"\bcurrent\b", r"\bwelding current\b", r"\barc current\b", r"\b\d+(?:\.\d+)?\s*(?:a|amp|amps|amperes)\b")),
        ("voltage", (r"\bvoltage\b", r"\barc voltage\b", r"\b\d+(?:\.\d+)?\s*(?:v|volt|volts)\b")),
        ("wire_feed_speed", (r"\bwire feed speed\b", r"\bwire-feed speed\b", r"\bwfs\b")),
        ("travel_speed", (r"\btravel speed\b", r"\bwelding speed\b", r"\bscan speed\b", r"\bdeposition speed\b")),
        ("torch_angle", (r"\btorch angle\b", r"\bgun angle\b", r"\belectrode angle\b")),
        ("shielding_gas", (r"\bshielding gas\b", r"\bargon\b", r"\bhelium\b", r"\bco2\b", r"\bgas mixture\b")),
        ("heat_input", (r"\bheat input\b", r"\benergy input\b")),
        ("pulse_frequency", (r"\bpulse frequency\b", r"\bpulsing frequency\b", r"\bpulse rate\b")),
        ("interpass_temperature", (r"\binterpass temperature\b", r"\binter-layer temperature\b")),
        ("layer_height", (r"\blayer height\b", r"\bdeposited layer height\b")),
        ("arc_length", (r"\barc length\b", r"\bstick-?out\b")),
        ("deposition_rate", (r"\bdeposition rate\b", r"\bmaterial deposition rate\b")),
    ),
    materials=(
        ("aluminum", (r"\baluminum\b", r"\baluminium\b", r"\baa\d{4}\b", r"\b4043\b", r"\b5356\b")),
        ("steel", (r"\bsteel\b", r"\b316l\b", r"\bstainless steel\b", r"\bmild steel\b")),
        ("titanium", (r"\btitanium\b", r"\bti-6al-4v\b", r"\bti64\b")),
        ("nickel", (r"\bnickel\b", r"\binconel\b", r"\bin718\b")),
        ("magnesium", (r"\bmagnesium\b", r"\baz91\b")),
    ),
    roles=(
        ("definition", (r"\bis defined as\b", r"\brefers to\b", r"\bcharacterized by\b")),
        ("cause", (r"\bcaused by\b", r"\bdue to\b", r"\battributed to\b", r"\boriginates from\b")),
        ("mechanism", (r"\bmechanism\b", r"\bleads to\b", r"\bpromotes\b", r"\bdrives\b", r"\bgas entrapment\b")),
        ("mitigation", (r"\bmitigat", r"\breduce", r"\bavoid", r"\bsuppress", r"\bminimiz")),
        ("result", (r"\bresults show\b", r"\bwe observed\b", r"\bthe experiments indicate\b", r"\breduced porosity\b", r"\bimproved density\b")),
        ("recommendation", (r"\bwe recommend\b", r"\bit is recommended\b", r"\bshould be\b")),
        ("limitation", (r"\blimitation\b", r"\bhowever\b", r"\bchallenge\b")),
        ("future work", (r"\bfuture work\b", r"\bfurther study\b", r"\bneeds additional investigation\b")),
    ),
    sections=(
        ("abstract", ("abstract",)),
        ("introduction", ("introduction", "background")),
        ("methodology", ("methodology", "materials and methods", "experimental setup", "experimental procedure")),
        ("results", ("results", "results and discussion", "discussion")),
        ("conclusions", ("conclusion", "conclusions")),
        ("recommendations", ("recommendation", "practical implication")),
        ("references", ("references", "bibliography")),
    ),
    aliases=(
        ("current", ("current", "welding current", "arc current")),
        ("voltage", ("voltage", "arc voltage")),
        ("wire_feed_speed", ("wire feed speed", "wire-feed speed", "wfs")),
        ("travel_speed", ("travel speed", "welding speed", "scan speed", "deposition speed")),
        ("shielding_gas", ("shielding gas", "argon", "helium", "gas flow", "gas composition")),
        ("heat_input", ("heat input", "energy input")),
        ("pulse_frequency", ("pulse frequency", "pulse rate", "pulsing frequency")),
        ("interpass_temperature", ("interpass temperature", "inter-layer temperature")),
        ("layer_height", ("layer height", "deposited layer height")),
        ("arc_length", ("arc length", "stick out", "stick-out")),
        ("deposition_rate", ("deposition rate", "material deposition rate")),
    ),
    mechanisms=(
        ("porosity", ("pore formation", "gas entrapment", "heat input", "shielding gas")),
        ("lack of fusion", ("insufficient heat input", "poor wetting", "shallow penetration")),
        ("crack", ("solidification", "residual stress", "thermal gradient")),
    ),
    reference_sections=("references", "bibliography", "literature cited"),
    reference_like=(r"\bdoi\b", r"https?://", r"\bet al\b", r"\b(?:19|20)\d{2}\b", r"\bvol\.\b", r"\bno\.\b", r"\bpp?\.\b"),
    background=(r"\bhas attracted\b", r"\bis widely used\b", r"\bhas been widely studied\b", r"\bplays an important role\b", r"\bthis paper presents\b", r"\bin recent years\b"),
    explanatory=r"\b(is|are|can|may|should|results|observed|reduce|increase|because|due to)\b",
    experimental=r"\bexperiment|observed|measured|sample|trial|results\b",
    review=r"\breview|survey|literature|published studies\b",
    mitigation=(("mitigation", "reduce", "reduced", "optimiz", "recommended", "minimiz"), ("mitigation", "recommendation", "result")),
    experiment=(("experiment", "observed", "measured", "results", "reduced porosity", "improved density"), ("result",)),
    mechanism=(("mechanism", "cause", "due to", "because", "promotes", "gas entrapment"), ("cause", "mechanism")),
    relations=("increase", "decrease", "higher", "lower", "too high", "too low", "window", "range", "effect"),
    strategy_cues=("mitigat", "reduce", "optimiz", "minimiz", "avoid"),
    mechanism_cues=("mechanism", "cause", "due to", "because", "promotes", "leads to"),
    recommendation_cues=("recommend", "should", "it is advised", "suggest"),
    outcome_cues=("results show", "observed", "reduced", "improved", "decreased"),
    effect_cues=("increase", "decrease", "higher", "lower", "too high", "too low", "window", "range"),
)

#: The same shape over words that the synthetic corpus holds, so that queries over it find something.
SYNTHETIC = replace(
    SCIENTIFIC,
    defects=(("heat", ("heat", "hea to")), ("stble", ("stble", "blest")), ("erin", ("erin", "ering the")), ("mente", ("mente", "menteo"))),
    processes=(("thand", ("thand", "andth")), ("onth", ("onth", "on the")), ("que", ("que la", "que los"))),
    parameters=(("current", (r"\bof\b", r"\bof the\b")), ("voltage", (r"\bwith\b", r"\bby\b")), ("shielding_gas", (r"\bder\b", r"\bdie\b")), ("heat_input", (r"\bheat\w*",))),
    materials=(("the", (r"\bthe\b",)), ("der", (r"\bder\b", r"\bund\b")), ("los", (r"\blos\b", r"\blas\b"))),
    roles=(("cause", (r"\bfrom\b",)), ("mechanism", (r"\bth\w+tion\b",)), ("mitigation", (r"\bre\w+ed\b",)), ("result", (r"\bis\b", r"\bwas\b")), ("recommendation", (r"\bto be\b", r"\bfor\b"))),
    sections=(("results", ("the ", "der ")), ("references", ("licen", "bibliography"))),
    aliases=(("current", ("of the", "of a")), ("voltage", ("with ", "by the")), ("heat_input", ("heat",))),
    mechanisms=(("heat", ("the heat", "heat of")), ("erin", ("erin in",))),
    reference_sections=("licensed under", "bibliography"),
    background=(r"\bof the\b", r"\bin the\b", r"\bde la\b", r"\bthis\b"),
    explanatory=r"\b(is|are|was|for|de|der)\b",
    experimental=r"\bheat|thing|eran\b",
    review=r"\breth|licen|ation\b",
    mitigation=(("heat", "reed", "bleed", "tion", "ing", "ound"), ("mitigation", "recommendation", "result")),
    experiment=(("was", "with", "tions", "erst", "anat", "ounded"), ("result",)),
    mechanism=(("from", "cause", "thea", "because", "esst", "ntin"), ("cause", "mechanism")),
    relations=("increase", "ering", "high", "lower", "of the", "in the", "edst", "range", "ouon"),
    strategy_cues=("reed", "heat", "tion"),
    mechanism_cues=("from", "thea", "ntin"),
    recommendation_cues=("for ", "to be", "ounde"),
    outcome_cues=("was", "erst", "anat"),
    effect_cues=("ering", "of the", "in the", "edst", "ouon", "with"),
)
