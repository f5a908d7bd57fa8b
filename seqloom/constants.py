"""Fixed values. They define the results, so they are stated as they are."""

AMINO = "ARNDCQEGHILKMFPSTWYV"
NUCLEOTIDES = "ACGT"
# accepted by scoring tables but without scores of their own (score 0)
AMBIGUOUS = "BZX"

# BLOSUM62, lower triangle, rows and columns in the order of AMINO
BLOSUM62_LOWER = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""

# pair HMM for proteins: start distribution (match, then two insert pairs),
# gap open and extend probability of the two insert pairs
HMM_START = (0.6814756989, 8.615339902e-05, 8.615339902e-05, 0.1591759622, 0.1591759622)
HMM_GAP_OPEN = (0.0119511066, 0.008008334786)
HMM_GAP_EXTEND = (0.3965826333, 0.8988758326)

# single emissions in the order of AMINO
HMM_SINGLE = (
    0.07831005, 0.05246024, 0.04433257, 0.05130349, 0.02189704,
    0.03585766, 0.05615771, 0.07783433, 0.02601093, 0.06511648,
    0.09716489, 0.05877077, 0.02438117, 0.04463228, 0.03940142,
    0.05849916, 0.05115306, 0.01203523, 0.03124726, 0.07343426,
)

# pair emissions, lower triangle, in the order of AMINO
HMM_PAIR_LOWER = """
0.02373072
0.00244502 0.01775118
0.00210228 0.00207782 0.01281864
0.00223549 0.00161657 0.00353540 0.01911178
0.00145515 0.00044701 0.00042479 0.00036798 0.01013470
0.00219102 0.00253532 0.00158223 0.00176784 0.00032102 0.00756604
0.00332218 0.00268865 0.00224738 0.00496800 0.00037956 0.00345128 0.01676565
0.00597898 0.00194865 0.00288882 0.00235249 0.00071206 0.00142432 0.00214860 0.04062876
0.00114353 0.00132105 0.00141205 0.00097077 0.00026421 0.00113901 0.00131767 0.00103704 0.00867996
0.00318853 0.00138145 0.00104273 0.00105355 0.00094040 0.00100883 0.00124207 0.00142520 0.00059716 0.01778263
0.00449576 0.00246811 0.00160275 0.00161966 0.00138494 0.00180553 0.00222063 0.00212853 0.00111754 0.01071834 0.03583921
0.00331693 0.00595650 0.00257310 0.00252518 0.00046951 0.00312308 0.00428420 0.00259311 0.00121376 0.00157852 0.00259626 0.01612228
0.00148878 0.00076734 0.00063401 0.00047808 0.00037421 0.00075546 0.00076105 0.00066504 0.00042237 0.00224097 0.00461939 0.00096120 0.00409522
0.00165004 0.00090768 0.00084658 0.00069041 0.00052274 0.00059248 0.00078814 0.00115204 0.00072545 0.00279948 0.00533369 0.00087222 0.00116111 0.01661038
0.00230618 0.00106268 0.00100282 0.00125381 0.00034766 0.00090111 0.00151550 0.00155601 0.00049078 0.00103767 0.00157310 0.00154836 0.00046718 0.00060701 0.01846071
0.00631752 0.00224540 0.00301397 0.00285226 0.00094867 0.00191155 0.00293898 0.00381962 0.00116422 0.00173565 0.00250962 0.00312633 0.00087787 0.00119036 0.00180037 0.01346609
0.00389995 0.00186053 0.00220144 0.00180488 0.00073798 0.00154526 0.00216760 0.00214841 0.00077747 0.00248968 0.00302273 0.00250862 0.00093371 0.00107595 0.00147982 0.00487295 0.01299436
0.00039119 0.00029139 0.00021006 0.00016015 0.00010666 0.00020592 0.00023815 0.00038786 0.00019097 0.00039549 0.00076736 0.00028448 0.00016253 0.00085751 0.00015674 0.00026525 0.00024961 0.00563625
0.00131840 0.00099430 0.00074960 0.00066005 0.00036626 0.00070192 0.00092548 0.00089301 0.00131038 0.00127857 0.00219713 0.00100817 0.00054105 0.00368739 0.00047608 0.00102648 0.00094759 0.00069226 0.00999315
0.00533241 0.00169359 0.00136609 0.00127915 0.00119152 0.00132844 0.00178697 0.00194579 0.00071553 0.01117956 0.00914460 0.00210897 0.00197461 0.00256159 0.00135781 0.00241601 0.00343452 0.00038538 0.00148001 0.02075171
"""

# nucleotide pair HMM, rows and columns in the order of NUCLEOTIDES; only the
# lower triangle is used
NUC_SINGLE = (0.35, 0.15, 0.25, 0.25)
NUC_PAIR_LOWER = """
0.1109
0.0744 0.0504
0.0947 0.0289 0.0760
0.0725 0.0438 0.0429 0.0844
"""

# nucleotide substitution scores, lower triangle
HOXD70_LOWER = """
91
-114 100
-31 -125 100
-123 -31 -114 91
"""
HOXD55_LOWER = """
91
-90 100
-25 -100 100
-100 -25 -90 91
"""

# emission probability of a letter / a pair outside the alphabet
UNKNOWN_SINGLE = 1e-5
UNKNOWN_PAIR = 1e-10

# smallest posterior kept by the partition function
PARTITION_FLOOR = 0.001

# amino-acid properties in bit order (bit 0 first)
PROPERTIES = (
    ("small", "ACDGNPSTV"),
    ("tiny", "ACGS"),
    ("aliphatic", "ILV"),
    ("aromatic", "FHWY"),
    ("hydrophobic", "ACFGHIKLMTVWY"),
    ("polar", "CDEHKNQRSTWY"),
    ("positive", "HKR"),
    ("negative", "DE"),
    ("charged", "DEHKR"),
    ("proline", "P"),
)

# conservation groups
STRONG_GROUPS = ("STA", "NEQK", "NHQK", "NDEQ", "QHRK", "MILV", "MILF", "HY", "FYW")
WEAK_GROUPS = ("CSA", "ATV", "SAG", "STNK", "STPA", "SGND", "SNDEQK", "NDEQHK", "NEHQRK", "FVLIM", "HFY")

# region search: low-score band, high-score threshold, minimum lengths by class
LOW_BAND = (0.0, 1.2)
HIGH_THRESHOLD = 2.0
MIN_LENGTH_BY_CLASS = (1, 10, 20, 30)
PEAK_SCORE = 1.0

# random numbers: multiplier and modulus of the small generator, its inverse
# range as used for the acceptance draw, and the default Mersenne Twister seed
LCG_MULTIPLIER = 75
LCG_MODULUS = 65537
LCG_INVERSE = 0.000015298473212373405
MT_SEED = 5489


def square(lower: str) -> list[list[float]]:
    """Full symmetric matrix from the text of its lower triangle."""
    rows = [[float(v) for v in line.split()] for line in lower.split("\n") if line.strip()]
    return [[rows[max(i, j)][min(i, j)] for j in range(len(rows))] for i in range(len(rows))]


def property_mask(letter: str) -> int:
    """Property bits of a letter; a letter outside AMINO has all of them."""
    if letter not in AMINO:
        return (1 << len(PROPERTIES)) - 1
    return sum(1 << i for i, (_, letters) in enumerate(PROPERTIES) if letter in letters)
