"""Word lists of the term classifiers.

Fixed values: the lists decide the results and are given in their natural
order.  All matching ignores case.  A list may be replaced or extended by
passing another one to the operators.
"""

SYSTEM_WORDS = {
    "A": [
        "DNA repair", "DNA damage", "genome stability", "chromosome", "telomere",
        "DNA replication", "DNA recombination", "mismatch repair", "base excision repair",
        "nucleotide excision repair", "homologous recombination", "non-homologous end joining",
        "stem cell", "progenitor", "differentiation", "cell fate", "lineage",
        "senescence", "apoptosis", "programmed cell death", "tissue homeostasis",
        "cell cycle", "proliferation", "regeneration", "wound healing",
        "protein folding", "proteostasis", "autophagy", "mitophagy", "lysosome",
        "endoplasmic reticulum", "organelle", "cytoskeleton", "membrane",
        "ion transport", "ion homeostasis", "osmotic", "pH regulation",
        "extracellular matrix", "ECM", "collagen", "angiogenesis",
        "resolution", "efferocytosis", "pro-resolving", "lipoxin", "resolvin",
        "protectin", "maresins", "tissue repair", "barrier function",
    ],
    "B": [
        "innate immun", "pattern recognition", "PRR", "TLR", "toll-like receptor",
        "inflammasome", "complement", "phagocytosis", "neutrophil", "macrophage",
        "dendritic cell", "natural killer", "NK cell", "interferon", "cytokine",
        "immune response", "inflammatory response", "inflammation",
        "adaptive immun", "T cell", "B cell", "antibody", "immunoglobulin",
        "antigen presentation", "MHC", "TCR", "BCR", "clonal selection",
        "immune memory", "vaccination", "cytotoxic", "helper T cell",
        "immune regulation", "tolerance", "regulatory T cell", "Treg",
        "immune checkpoint", "PD-1", "CTLA-4", "immunosuppression",
        "self-tolerance", "peripheral tolerance", "anergy",
    ],
    "C": [
        "glycolysis", "gluconeogenesis", "citric acid cycle", "TCA cycle",
        "oxidative phosphorylation", "electron transport", "ATP synthesis",
        "fatty acid oxidation", "beta-oxidation", "amino acid catabolism",
        "biosynthesis", "anabolism", "fatty acid synthesis", "cholesterol synthesis",
        "protein synthesis", "amino acid synthesis", "nucleotide synthesis",
        "glycogen synthesis", "lipogenesis", "steroid synthesis",
        "detoxification", "xenobiotic", "drug metabolism", "cytochrome P450",
        "glutathione", "oxidative stress", "antioxidant", "reactive oxygen species",
        "ROS", "peroxisome", "phase I metabolism", "phase II metabolism",
    ],
    "D": [
        "neural", "neuron", "synapse", "neurotransmitter", "action potential",
        "signal transduction", "sensory", "motor", "reflex", "nervous system",
        "brain", "spinal cord", "peripheral nerve", "axon", "dendrite",
        "nervous system development", "neural development",
        "hormone", "endocrine", "hypothalamus", "pituitary", "adrenal",
        "thyroid", "insulin", "glucagon", "cortisol", "growth hormone",
        "autonomic", "sympathetic", "parasympathetic", "circadian", "rhythm",
    ],
    "E": [
        "reproduction", "reproductive", "gamete", "sperm", "egg", "oocyte",
        "fertilization", "mating", "sexual", "gonad", "testis", "ovary",
        "pregnancy", "gestation", "embryo", "fetus", "placenta", "lactation",
        "development", "embryonic", "morphogenesis", "organogenesis",
        "pattern formation", "cell migration", "gastrulation", "neurulation",
        "limb development", "sex determination", "puberty", "maturation",
    ],
    "0": [
        "transcription", "translation", "ribosome", "RNA processing",
        "splicing", "mRNA", "tRNA", "rRNA", "protein transport",
        "vesicle transport", "endocytosis", "exocytosis", "secretion",
        "cell division", "mitosis", "meiosis", "chromosome segregation",
    ],
}
PRIORITY = {"B": 1, "A": 2, "D": 3, "E": 4, "C": 5, "0": 6}

SUBSYSTEM_WORDS = {
    "A": {
        "A1": ["DNA", "genome", "chromosome", "telomere", "repair"],
        "A2": ["stem", "differentiation", "senescence", "apoptosis", "regeneration"],
        "A3": ["protein folding", "autophagy", "organelle", "homeostasis", "cytoskeleton"],
        "A4": ["resolution", "efferocytosis", "pro-resolving", "tissue repair"],
    },
    "B": {
        "B1": ["innate", "pattern recognition", "TLR", "complement", "phagocytosis"],
        "B2": ["adaptive", "T cell", "B cell", "antibody", "antigen"],
        "B3": ["regulation", "tolerance", "regulatory", "checkpoint", "suppression"],
    },
    "C": {
        "C1": ["glycolysis", "oxidation", "catabolism", "ATP", "energy"],
        "C2": ["biosynthesis", "anabolism", "synthesis", "lipogenesis"],
        "C3": ["detoxification", "xenobiotic", "cytochrome P450", "antioxidant"],
    },
    "D": {
        "D1": ["neural", "neuron", "synapse", "neurotransmitter", "nervous"],
        "D2": ["hormone", "endocrine", "autonomic", "circadian"],
    },
    "E": {
        "E1": ["reproduction", "gamete", "fertilization", "pregnancy", "lactation"],
        "E2": ["development", "embryonic", "morphogenesis", "maturation"],
    },
}
SPECIFICITY = {
    "A1": 1.2, "A2": 1.0, "A3": 0.9, "A4": 1.1,
    "B1": 1.0, "B2": 1.1, "B3": 1.2,
    "C1": 1.0, "C2": 1.0, "C3": 1.1,
    "D1": 1.0, "D2": 1.1,
    "E1": 1.1, "E2": 1.0,
}

#: in order of precedence
POLARITY_WORDS = {
    "pro-resolving": ["pro-resolving", "resolution", "lipoxin", "resolvin", "protectin", "maresins",
                      "efferocytosis", "tissue repair"],
    "anti-inflammatory": ["anti-inflammatory", "IL-10", "TGF-beta", "regulatory", "suppression",
                          "tolerance", "resolution", "dampening"],
    "pro-inflammatory": ["pro-inflammatory", "inflammatory", "IL-1", "TNF", "IL-6", "NF-kB",
                         "inflammasome", "pyroptosis", "inflammatory response"],
}
POLARITY_WEIGHTS = {"pro-resolving": 1.3, "anti-inflammatory": 1.1, "pro-inflammatory": 1.0}

#: whole names of terms too general to classify
GENERAL_NAMES = [
    "biological_process", "cellular_process", "metabolic_process",
    "regulation of biological_process", "positive regulation of biological_process",
    "negative regulation of biological_process", "cellular component organization",
    "biological regulation",
]

DESTRUCTIVE_WORDS = [
    "kill", "destroy", "eliminate", "attack", "cytotox", "lysis", "death", "apoptosis",
    "degradation", "breakdown", "clearance", "removal", "antimicrobial", "bactericidal",
    "destruction", "elimination",
]
CONSTRUCTIVE_WORDS = [
    "repair", "heal", "regenerat", "reconstruct", "restore", "maintain", "homeostasis",
    "synthesis", "biosynthesis", "formation", "assembly", "construction", "development",
    "reconstruction",
]
DESTRUCTIVE_WEIGHTS = {
    "kill|killing": 3.0, "destroy|destruction": 3.0, "eliminate|elimination": 2.5,
    "attack|attacking": 2.5, "cytotox|cytotoxic": 3.0, "lysis|lytic": 2.5, "death|dying": 2.0,
    "apoptosis|apoptotic": 2.0, "degradation|degrade": 2.0, "breakdown|break down": 2.0,
    "clearance|clear": 1.5, "removal|remove": 1.5, "antimicrobial": 2.5, "bactericidal": 2.5,
}
CONSTRUCTIVE_WEIGHTS = {
    "repair|repairing": 3.0, "heal|healing": 3.0, "regenerat|regeneration": 3.0,
    "reconstruct|reconstruction": 2.5, "restore|restoration": 2.5, "maintain|maintenance": 2.0,
    "homeostasis|homeostatic": 2.5, "synthesis|synthesize": 2.0, "biosynthesis|biosynthetic": 2.0,
    "formation|form": 1.5, "assembly|assemble": 1.5, "construction|construct": 2.0,
    "development|develop": 1.5,
}
DOMINANCE = 1.5
COMPLEX_DISCOUNT = 0.8

#: in order of precedence on equal counts
OBJECTIVE_WORDS = {
    "threat_elimination": ["pathogen", "infection", "invader", "foreign", "threat"],
    "tissue_repair": ["wound", "injury", "damage", "tissue repair", "recovery"],
    "immune_defense": ["immune", "defense", "protection", "surveillance"],
    "structural_maintenance": ["maintenance", "stability", "integrity", "preservation"],
    "metabolic_support": ["energy", "metabolism", "nutrient", "resource"],
}
OBJECTIVE_SYSTEMS = {
    "threat_elimination": "B", "tissue_repair": "A", "immune_defense": "B",
    "structural_maintenance": "A", "metabolic_support": "C",
}

#: what an inflammatory process is about, in order of precedence
INFLAMMATION_WORDS = {
    "threat": ["pathogen", "recognition", "clearance", "killing", "cytotox", "antimicrobial",
               "bactericidal", "antiviral"],
    "tolerance": ["tolerance", "regulatory", "suppression", "checkpoint", "self-limitation",
                  "immune regulation"],
    "resolution": ["resolution", "resolving", "efferocytosis", "lipoxin", "resolvin", "protectin",
                   "maresins"],
    "repair": ["repair", "healing", "regeneration", "reconstruction", "tissue repair", "wound healing"],
}

SYSTEM_NAMES = {
    "A": "System A: Self-Healing & Structural Reconstruction",
    "B": "System B: Immune Defense",
    "C": "System C: Energy & Metabolic Homeostasis",
    "D": "System D: Cognitive-Regulatory",
    "E": "System E: Reproduction & Continuity",
    "0": "System 0: General Molecular Machinery",
}
SUBSYSTEM_NAMES = {
    "A1": "Genomic Stability and Repair",
    "A2": "Somatic Maintenance and Identity Preservation",
    "A3": "Cellular Homeostasis and Structural Maintenance",
    "A4": "Inflammation Resolution and Damage Containment",
    "B1": "Innate Immunity",
    "B2": "Adaptive Immunity",
    "B3": "Immune Regulation and Tolerance",
    "C1": "Energy Metabolism and Catabolism",
    "C2": "Biosynthesis and Anabolism",
    "C3": "Detoxification and Metabolic Stress Handling",
    "D1": "Neural Regulation and Signal Transmission",
    "D2": "Endocrine and Autonomic Regulation",
    "E1": "Reproduction",
    "E2": "Development and Reproductive Maturation",
}

#: graded words of the probabilistic classifier: high, medium, low
GRADE_WEIGHTS = (3.0, 2.0, 1.0)
SYSTEM_WEIGHTS = {"0": 0.8, "A": 1.0, "B": 1.2, "C": 1.0, "D": 1.0, "E": 1.0}
LEAST_PROBABILITY = 0.1
GRADED_WORDS = {
    "0": (["ribosome", "ribosomal", "proteasome", "spliceosome"],
          ["translation", "rna polymerase", "dna replication"],
          ["ubiquitin", "protein folding", "rna splicing"]),
    "A1": (["dna repair", "dna damage", "homologous recombination"],
           ["excision repair", "mismatch repair", "p53", "telomere"],
           ["checkpoint", "dna integrity", "mutation repair"]),
    "A2": (["apoptosis", "cell cycle", "cell death"],
           ["apoptotic", "necrosis", "autophagy", "mitosis"],
           ["proliferation", "growth", "caspase", "bcl-2"]),
    "A3": (["transport", "membrane transport", "homeostasis"],
           ["ion channel", "cytoskeleton", "endocytosis"],
           ["motility", "junction", "adhesion", "vesicle", "trafficking"]),
    "B1": (["innate immune", "inflammation", "inflammatory"],
           ["toll-like", "complement", "phagocytosis", "interferon"],
           ["neutrophil", "macrophage", "nf-kappa b", "cytokine-cytokine"]),
    "B2": (["adaptive immune", "immune response", "antibody"],
           ["t cell", "b cell", "antigen", "mhc", "lymphocyte"],
           ["immunoglobulin", "immunological", "cd4", "cd8", "tcr"]),
    "C1": (["glycolysis", "glycolytic", "energy metabolism", "mitochondrial"],
           ["tca cycle", "oxidative phosphorylation", "atp synthesis"],
           ["glucose metabolism", "fatty acid oxidation", "respiration", "metabolic process"]),
    "C2": (["biosynthesis", "biosynthetic", "anabolism"],
           ["fatty acid biosynthesis", "amino acid biosynthesis"],
           ["protein synthesis", "lipogenesis", "steroid biosynthesis"]),
    "C3": (["xenobiotics", "detoxification", "drug metabolism"],
           ["cytochrome p450", "glutathione", "oxidative stress"],
           ["antioxidant", "peroxisome", "reactive oxygen"]),
    "D1": (["nervous system", "synaptic", "neurotransmitter"],
           ["synapse", "neuron", "neuronal", "neuroactive"],
           ["brain", "axon", "dopaminergic", "serotonergic", "behavior"]),
    "D2": (["endocrine", "hormone", "steroid hormone"],
           ["insulin", "glucagon", "thyroid", "estrogen"],
           ["cortisol", "androgen", "ppar signaling", "adipocytokine"]),
    "E1": (["reproduction", "reproductive", "meiosis"],
           ["meiotic", "gamete", "fertilization"],
           ["sperm", "oocyte", "ovarian", "progesterone"]),
    "E2": (["development", "differentiation", "morphogenesis"],
           ["embryo", "organogenesis", "maturation"],
           ["aging", "senescence", "longevity"]),
}

#: words of the first-match classifier; labels are tried in this order
FIRST_MATCH_WORDS = {
    "0": ["ribosome", "ribosomal", "translation", "trna processing", "proteasome", "ubiquitin",
          "protein folding", "spliceosome", "rna splicing", "mrna processing",
          "basal transcription", "rna polymerase", "dna replication", "chromosome segregation"],
    "B1": ["innate immune", "inflammation", "inflammatory", "toll-like", "nod-like", "rig-i",
           "phagocytosis", "complement activation", "neutrophil", "macrophage",
           "cytokine production", "interferon", "interleukin", "nf-kappa b",
           "pattern recognition", "cytokine-cytokine"],
    "B2": ["adaptive immune", "t cell", "b cell", "antigen", "antibody", "mhc", "lymphocyte",
           "th1", "th2", "th17", "immunoglobulin", "hematopoietic", "immune response",
           "immunological", "cd4", "cd8", "tcr"],
    "D1": ["nervous system", "synapse", "synaptic", "neurotransmitter", "axon", "neuron",
           "neuronal", "brain", "cholinergic", "dopaminergic", "serotonergic", "glutamatergic",
           "neurotrophin", "neuroactive", "ligand-receptor", "feeding behavior", "behavior"],
    "D2": ["endocrine", "hormone", "insulin", "glucagon", "cortisol", "thyroid", "estrogen",
           "androgen", "steroid hormone", "adipocytokine", "ppar signaling", "renin-angiotensin"],
    "E1": ["reproduction", "reproductive", "meiosis", "meiotic", "gamete", "sperm", "oocyte",
           "fertilization", "ovarian", "progesterone"],
    "E2": ["development", "differentiation", "morphogenesis", "embryo", "organogenesis", "aging",
           "senescence", "longevity", "maturation"],
    "C3": ["xenobiotics", "xenobiotic", "drug metabolism", "cytochrome p450", "glutathione",
           "detoxification", "antioxidant", "peroxisome", "phase i", "phase ii",
           "oxidative stress", "reactive oxygen"],
    "C1": ["glycolysis", "glycolytic", "tca cycle", "citrate cycle", "oxidative phosphorylation",
           "mitochondria", "mitochondrial", "atp synthesis", "respiration", "energy metabolism",
           "thermogenesis", "glucose metabolism", "lipid metabolic", "fatty acid oxidation",
           "metabolic process"],
    "C2": ["biosynthesis", "biosynthetic", "anabolism", "fatty acid biosynthesis",
           "amino acid biosynthesis", "nucleotide biosynthesis", "starch", "sucrose",
           "protein synthesis", "lipogenesis", "cholesterol biosynthesis", "steroid biosynthesis"],
    "A1": ["dna repair", "excision repair", "mismatch repair", "homologous recombination",
           "non-homologous", "dna damage", "p53", "telomere", "checkpoint", "dna integrity",
           "mutation repair"],
    "A2": ["apoptosis", "apoptotic", "necrosis", "autophagy", "cell death", "cell cycle",
           "mitosis", "cell division", "proliferation", "growth", "programmed cell death",
           "caspase", "bcl-2"],
    "A3": ["homeostasis", "transport", "membrane transport", "ion channel", "cytoskeleton",
           "motility", "junction", "adhesion", "lysosome", "endocytosis", "exocytosis",
           "vesicle", "trafficking"],
}

#: set-valued classifier: (label, pattern on the text, pattern that forbids it)
SET_RULES = [
    ("E", r"\b(meiosis|meiotic|gamet|sperm|oocyte|fertiliz|pregnan|embryo development|germ cell|mating|insemination|ovulation|placenta|parturition)\b",
     r"\b(cell cycle|mitosis|mitotic|proliferation)\b"),
    ("A", r"\b(angiogene|coagulat|regeneration|hemostasis|clot|extracellular matrix|collagen|ossification|vasculature|stem cell)\b", None),
    ("A", r"\b(morphogenesis|organogenesis|tissue development|organ development|anatomical structure development)\b",
     r"\b(gonad|oocyte|sperm|gamete|reproductive)\b"),
    ("A", r"\b(cell cycle|mitosis|mitotic|cell division|cell proliferation|cell growth)\b", r"(meiosis|meiotic)"),
    ("A", r"\b(muscle|cardiac|cardiocyte|myoblast|myocyte|heart development)\b", None),
    ("A", r"\b(osteoblast|chondrocyte|bone|cartilage|skeletal)\b", None),
    ("A", r"\b(growth factor|tgf|fgf|egf|vegf|pdgf)\b", None),
    ("B", r"\b(defense|leukocyte|cytokine|inflammat|b cell|t cell|lymph|phagocyt|chemotaxis|antigen|interferon|chemokine)\b", None),
    ("B", r"\b(bacteri|vir[au]l|fungal|parasit|host|symbiont|killing of cells|pathogen)\b", None),
    ("D neuro", r"\b(neuro|synap|axon|brain|behavior|sensory|perception|action potential|ion channel)\b", None),
    ("D neuro", r"\b(dopamine|serotonin|catecholamine|acetylcholine|neuropeptide|glial|memory|learning|locomotion)\b", None),
    ("D endo", r"\b(hormone|endocrine|circadian|adrenal|pituitary|thyroid|insulin|glucagon|corticosteroid|estrogen|androgen)\b", None),
    ("C", r"\b(metabol|biosynthe|catabol|respiration|fermentation|glycoly|gluconeo)\b", None),
    ("C", r"\b(fatty acid|lipid|carbohydrate|amino acid|nucleotide|vitamin|cofactor)\b", None),
]
#: transport counts for C only where nothing neural was found
SET_TRANSPORT = r"\b(lipid transport|glucose transport|amino acid transport|ion transport|transmembrane transport|cation transport|anion transport)\b"
SET_ANCESTORS = {
    "E": ["reproductive process"],
    "A": ["response to wounding", "wound healing"],
    "B": ["immune system process"],
    "D neuro": ["nervous system process"],
    "C": ["metabolic process"],
}
SET_PRIORITY = ["E", "B", "D neuro", "D endo", "A", "C"]

# Name and description of each subcategory.
SUBCATEGORY_TEXTS = {
    "A1": ("Genomic Stability and Repair", "DNA damage sensing/repair, chromatin maintenance, telomere maintenance"),
    "A2": ("Somatic Maintenance and Identity Preservation", "Stem/progenitor maintenance, differentiation, senescence programs"),
    "A3": ("Cellular Homeostasis and Structural Maintenance", "Proteostasis, autophagy, organelle biogenesis and repair"),
    "A4": ("Inflammation Resolution and Damage Containment", "Efferocytosis, pro-resolving mediators, tissue homeostasis restoration"),
    "B1": ("Innate Immunity", "Pattern recognition, inflammatory signaling, phagocytosis"),
    "B2": ("Adaptive Immunity", "Antigen-specific responses, immune memory, targeted effectors"),
    "B3": ("Immune Regulation and Tolerance", "Negative feedback control, checkpoint regulation, tolerance mechanisms"),
    "C1": ("Energy Metabolism and Catabolism", "Nutrient breakdown, ATP generation, redox balancing"),
    "C2": ("Biosynthesis and Anabolism", "Macromolecular building blocks synthesis, growth demands"),
    "C3": ("Detoxification and Metabolic Stress Handling", "Xenobiotic transformation, harmful metabolite elimination"),
    "D1": ("Neural Regulation and Signal Transmission", "Neural signaling, synaptic communication, sensor-motor integration"),
    "D2": ("Endocrine and Autonomic Regulation", "Hormonal signaling, autonomic control, physiological set-points"),
    "E1": ("Reproduction", "Gametogenesis, reproductive endocrine, fertilization, gestation"),
    "E2": ("Development and Reproductive Maturation", "Embryonic development, sex differentiation, reproductive competence"),
}
