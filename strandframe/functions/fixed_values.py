"""Values that must equal published or agreed ones for results to be right."""

# The standard genetic code, in the published TCAG order of the three bases.
CODON_BASES = "TCAG"
CODON_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# IUPAC nucleotide codes as character classes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

# Sequencing adapters.
ADAPTERS = {
    "illumina_nextera": "CTGTCTCTTATACACATCT",
    "illumina_truseq_rna": "AGATCGGAAGAGCACACGTCT",
    "illumina_truseq_dna": "AGATCGGAAGAGCGTCGTGTAG",
    "polya": "AAAAAAAAAA",
    "polyg": "GGGGGGGGGG",
}

# Protospacer-adjacent motifs.
PAM = {"SpCas9": "NGG", "SaCas9": "NNGRRT", "Cas12a": "TTTV", "SpCas9-HF1": "NGG"}

# Marker k-mers of the small built-in taxon index.
TAXON_KMERS = {
    "ATCGATCGATCGATCG": "Escherichia coli",
    "GCTAGCTAGCTAGCTA": "Staphylococcus aureus",
    "TTTTAAAACCCCGGGG": "Bacillus subtilis",
    "AAAACCCCGGGGTTTT": "Lactobacillus acidophilus",
}

# Residue scales, in the order of RESIDUES.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
HYDROPATHY = dict(zip(RESIDUES, (
    1.8, -4.5, -3.5, -3.5, 2.5, -3.5, -3.5, -0.4, -3.2, 4.5,
    3.8, -3.9, 1.9, 2.8, -1.6, -0.8, -0.7, -0.9, -1.3, 4.2)))
ACCESSIBILITY = dict(zip(RESIDUES, (
    1.252, 1.326, 1.534, 1.589, 1.145, 1.508, 1.534, 0.990, 1.534, 1.100,
    1.100, 1.448, 1.100, 1.100, 0.990, 1.495, 1.495, 1.100, 1.379, 1.100)))
FLEXIBILITY = dict(zip(RESIDUES, (
    0.984, 1.012, 1.047, 1.029, 0.905, 1.012, 1.012, 1.047, 0.950, 0.905,
    0.905, 1.012, 0.905, 0.905, 1.047, 1.047, 1.047, 0.950, 0.950, 0.905)))
PROPENSITY = dict(zip(RESIDUES, (
    0.69, 0.73, 0.89, 1.10, 1.15, 1.10, 1.33, 0.55, 0.95, 0.51,
    0.53, 1.24, 0.64, 0.40, 0.69, 0.80, 0.72, 0.32, 0.43, 0.57)))
ANCHOR = dict(zip(RESIDUES, (
    0.5, 0.0, 0.1, 0.0, 0.3, 0.2, 0.0, 0.1, 0.1, 1.0,
    1.0, 0.0, 0.8, 0.7, 0.2, 0.2, 0.3, 0.6, 0.5, 1.0)))

# Preferred residues at the second and the last place, by MHC supertype.
SUPERTYPES = {
    "A0201": ("AVLIM", "VILM"),
    "A0101": ("TSNQD", "VILMF"),
    "A0301": ("KRNQST", "KRY"),
    "A2402": ("FYW", "FLIVMW"),
    "B0702": ("P", "LMFW"),
    "B2705": ("RHKDEN", "LFVSM"),
    "B4001": ("EKQR", "LIVMF"),
    "B5801": ("SA", "LIVMF"),
}

# Residues favouring and hindering proteasomal cleavage.
CLEAVAGE_FAVOURABLE = "AGSVLMT"
CLEAVAGE_UNFAVOURABLE = "PDERKNQHFYW"

# Restriction enzymes as name, recognition site, cut offset from the start of the site.
_ENZYMES = """
AatII GACGTC 1
Acc65I GGTACC 1
AflII CTTAAG 1
AflIII ACRYGT 1
AgeI ACCGGT 1
AluI AGCT 2
ApaI GGGCCC 1
ApaLI GTGCAC 1
ApoI RAATTY 1
AscI GGCGCGCC 2
AvaI CYCGRG 1
AvaII GGWCC 1
AvrII CCTAGG 1
BaeI ACGRAC 1
BamHI GGATCC 1
BanI GGYRCC 1
BanII GRAGCY 1
BbsI GAAGAC 2
BcgI CGANNNNNNTGC 2
BciVI GTATCC 1
BclI TGATCA 1
BfaI CTAG 1
BfuAI ACCTGC 1
BglI GCCNNNNNGGC 2
BglII AGATCT 1
BmtI GCTAGC 1
BsaI GGTCTC 1
BsaHI GRCGYC 1
BsaWI WCCGGW 1
BseRI GAGGAG 1
BsgI GTGCAG 1
BsiWI CGTACG 1
BslI CCNNNNNNNGG 2
BsmAI GTCTC 1
BsmFI GGGAC 1
BsoBI CYCGRG 1
Bsp1286I GDGCHC 1
BspEI TCCGGA 1
BspHI TCATGA 1
BspMI ACCTGC 1
BsrFI RCCGGY 1
BsrGI TGTACA 1
BstBI TTCGAA 1
BstEI GGTNACC 1
BstNI CCWGG 1
BstUI CGCG 2
BstXI CCANNNNNNTGG 2
BstZ17I GTATAC 1
BsuRI GGCC 2
BtgI CCRGAG 1
BtgZI GCGACG 1
BtsI GCAGTG 1
BveI ACCTGC 1
Cac8I GCNNGC 1
ClaI ATCGAT 1
CviAII CATG 1
CviJI RGYRCA 1
DdeI CTNAG 1
DpnI GATC 1
DraI TTTAAA 1
DraIII CACGTG 1
DrdI GACNNNNNGTC 1
EaeI YGGCCR 1
EagI CGGCCG 1
EarI GCTCTTC 1
EciI TGGCCA 1
EcoNI CCTNNNNNAGG 1
EcoO109I RGGNCCY 1
EcoRI GAATTC 1
EcoRV GATATC 1
EcoT22I ATGCAT 1
FatI CATG 1
FauI CCCGC 2
Fnu4HI GCNGC 1
FokI GGATG 1
FseI GGCCGGCC 2
FspI TGCGCA 1
HaeII RGCGCY 1
HaeIII GGCC 2
HgaI GACGC 1
HhaI GCGC 1
HindIII AAGCTT 1
HinfI GANTC 1
HpaI GTTAAC 1
HpaII CCGG 1
Hpy188I TCNGA 1
Hpy188III TCNNGA 1
HpyAV ACCTT 1
HpyCH4III ACGT 1
HpyCH4IV ACGT 1
KasI GGCGCC 1
KpnI GGTACC 1
MboI GATC 1
MboII GAAGA 1
MfeI CAATTG 1
MluI ACGCGT 1
MluCI AATT 1
MmeI TCCRAC 1
MnlI CCTC 1
MseI TTAA 1
MslI CAYNNNNRTG 1
MspA1I CMGCAG 1
MspI CCGG 1
MwoI GCNNNNNNNGC 1
NaeI GCCGGC 1
NarI GGCGCC 1
NcoI CCATGG 1
NdeI CATATG 1
NgoMIV GCCGGC 1
NheI GCTAGC 1
NlaIII CATG 1
NlaIV GGNNCC 1
NotI GCGGCCGC 2
NruI TCGCGA 1
NsiI ATGCAT 1
NspI RCATGY 1
NspBIII CMGCKG 1
PacI TTAATTAA 2
PaeR7I CTCGAG 1
PciI ACATGT 1
PmeI GTTTAAAC 2
PmlI CACGTG 1
PpuMI RGGWCCY 1
PstI CTGCAG 1
PvuI CGATCG 1
PvuII CAGCTG 1
RsaI GTAC 2
RsrII CGGACCG 1
SacI GAGCTC 1
SacII CCGCGG 1
SalI GTCGAC 1
SapI GCTCTTC 1
Sau3AI GATC 1
Sau96I GGNCC 1
SbfI CCTGCAGG 2
ScaI AGTACT 1
ScrFI CCNGG 1
SexAI ACCWGGT 1
SfaNI GCATC 1
SfiI GGCCNNNNNGGCC 2
SfoI GGCGCC 1
SgrAI CRCCGGYG 1
SmaI CCCGGG 3
SmlI CTYRAG 1
SnaBI TACGTA 1
SpeI ACTAGT 1
SphI GCATGC 1
SplI CGTACG 1
SrfI GCCCGGGC 1
Sse8387I CCTGCAGG 1
SspI AATATT 1
StuI AGGCCT 1
StyI CCWWGG 1
StyD4I CCNGG 1
TaiI ACGT 1
TaqI TCGA 1
TfiI GAWTC 1
TseI GCWGC 1
Tsp45I GTSAC 1
Tsp509I AATT 1
TsrI GGNCC 1
Tth111I GACNNNGTC 1
XbaI TCTAGA 1
XcmI CCANNNNNNTGG 2
XhoI CTCGAG 1
XmaI CCCGGG 1
XmaCI CCGG 1
XmnI GAANNNNTTC 1
ZraI GACGTC 1
"""
ENZYMES = {n: (s, int(c)) for n, s, c in (line.split() for line in _ENZYMES.split("\n") if line)}
