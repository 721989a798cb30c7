"""Expected results that no SQL computes: verdicts on pairs of names, and spellings to try, each as its rules give it by hand."""

from __future__ import annotations

GOLD = [
    ("Taurochenodeoxycholic acid", "Urocortisol", "conflict"), ("Taurochenodeoxycholic acid", "Tetrahydrocortisol", "conflict"),
    ("LysoPC(P-16:0)", "1-Acyl-sn-glycero-3-phosphocholine", "conflict"), ("LysoPC(16:0)", "1-Acyl-sn-glycero-3-phosphocholine", "class-level"),
    ("nLc4Cer", "1,3-beta-D-Galactosyl-N-acetyl-D-glucosaminyl-1,3-beta-D-galactosyl-1,4-D-glucosylceramide", "conflict"),
    ("Lc3Cer", "nLc4Cer", "conflict"), ("15-HETE", "15-Hydroperoxyeicosatetraenoic acid", "conflict"), ("15-HETE", "5,15-DiHETE", "conflict"),
    ("N1-Acetylspermine", "N1-Acetylspermidine", "conflict"), ("LysoPC(16:0)", "LysoPC(16:0/0:0)", "ok"), ("LysoPC(16:0)", "LysoPC(18:2/0:0)", "conflict"),
    ("Glycochenodeoxycholic acid", "Glycochenodeoxycholate", "ok"), ("Spermine", "Spermine", "ok"), ("1-Linoleoylglycerophosphocholine", "LysoPC(18:2)", "ambiguous"),
]

#: Spellings of the names of the domain, in order; names that are not here have none.
SPELLINGS = {
    "Taurochenodeoxycholic acid": [
        "chenodeoxytaurocholate",
        "chenodeoxytaurocholic acid",
        "chenodeoxycholyltaurine",
    ],
    "LysoPC(P-16:0)": [
        "1-1Z-hexadecenyl-sn-glycero-3-phosphocholine",
        "1-1Z-hexadecenylglycero-3-phosphocholine",
        "1Z-hexadecenyl lysophosphatidylcholine",
        "lysophosphatidylcholine 16:0",
        "lysophosphatidylcholine",
        "plasmenylcholine",
        "1-alkenyl-2-acyl-sn-glycero-3-phosphocholine",
        "1-alkenyl-sn-glycero-3-phosphocholine",
        "LysoPC",
        "LPC(P-16:0)",
    ],
    "LysoPC(16:0)": [
        "1-palmitoyl-sn-glycero-3-phosphocholine",
        "1-palmitoylglycero-3-phosphocholine",
        "palmitoyl lysophosphatidylcholine",
        "1-hexadecanoyl-sn-glycero-3-phosphocholine",
        "1-hexadecanoylglycero-3-phosphocholine",
        "hexadecanoyl lysophosphatidylcholine",
        "lysophosphatidylcholine 16:0",
        "lysophosphatidylcholine",
        "LysoPC",
        "LPC(16:0)",
    ],
    "LysoPC(16:0/0:0)": [
        "1-palmitoyl-sn-glycero-3-phosphocholine",
        "1-palmitoylglycero-3-phosphocholine",
        "palmitoyl lysophosphatidylcholine",
        "1-hexadecanoyl-sn-glycero-3-phosphocholine",
        "1-hexadecanoylglycero-3-phosphocholine",
        "hexadecanoyl lysophosphatidylcholine",
        "lysophosphatidylcholine 16:0",
        "lysophosphatidylcholine 0:0",
        "lysophosphatidylcholine",
        "LysoPC",
        "LPC(16:0/0:0)",
    ],
    "LysoPC(18:2/0:0)": [
        "1-linoleoyl-sn-glycero-3-phosphocholine",
        "1-linoleoylglycero-3-phosphocholine",
        "linoleoyl lysophosphatidylcholine",
        "1-octadecadienoyl-sn-glycero-3-phosphocholine",
        "1-octadecadienoylglycero-3-phosphocholine",
        "octadecadienoyl lysophosphatidylcholine",
        "lysophosphatidylcholine 18:2",
        "lysophosphatidylcholine 0:0",
        "lysophosphatidylcholine",
        "LysoPC",
        "LPC(18:2/0:0)",
    ],
    "nLc4Cer": [
        "lactoneotetraosylceramide",
        "neolactotetraosylceramide",
        "paragloboside",
        "Gal-beta1-4-GlcNAc-beta1-3-Gal-beta1-4-Glc-ceramide",
        "(Gal)2 (Glc)1 (GlcNAc)1 (Cer)1",
    ],
    "Lc3Cer": [
        "lactotriaosylceramide",
        "acetylglucosaminylgalactosylglucosylceramide",
        "GlcNAc-beta1-3-Gal-beta1-4-Glc-ceramide",
        "(Gal)1 (Glc)1 (GlcNAc)1 (Cer)1",
    ],
    "15-HETE": [
        "15-hydroxyeicosatetraenoic acid",
        "15-hydroxyicosatetraenoic acid",
        "15(S)-HETE",
    ],
    "N1-Acetylspermine": [
        "monoacetylspermine",
    ],
    "N1-Acetylspermidine": [
        "monoacetylspermidine",
    ],
    "TMAO(trimethylamine N-oxide)": [
        "TMAO",
    ],
    "4-(Dimethylamino)benzoic acid": [
        "4-benzoic acid",
    ],
    "Glycochenodeoxycholic acid": [
        "chenodeoxyglycocholate",
        "chenodeoxyglycocholic acid",
        "chenodeoxycholylglycine",
    ],
}
