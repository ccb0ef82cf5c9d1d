"""Statistics of public cohorts behind the built-in profiles. Bin edges follow from the rules in ``operators.histograms``."""

# What was measured on each cohort.
COHORTS = {
    "germline-1kgp": {
        "source": "1000 Genomes high-coverage genotypes, GRCh38",
        "n_samples": 3202,
        "n_variants": 73652396,
        "fitted_on": "2026-07-16",
        "supplied": ["ploidy"],
        # contig, variants, variants per kb
        "contigs": (
            ("1", 5759060, 23.133767893897524),
            ("10", 3495473, 26.127071952419076),
            ("11", 3423341, 25.343709533133193),
            ("12", 3332788, 25.00877426339335),
            ("13", 2509179, 21.942214800392602),
            ("14", 2290400, 21.428899889735284),
            ("15", 2109285, 20.683086413035554),
            ("16", 2362361, 26.18205002208454),
            ("17", 2073624, 24.909964302858224),
            ("18", 1963845, 24.467577017091703),
            ("19", 1670692, 28.50673752383187),
            ("2", 6088598, 25.140452494434896),
            ("20", 1644384, 25.560058125294184),
            ("21", 1002753, 21.472259625919342),
            ("22", 1066557, 20.991905351622393),
            ("3", 4983185, 25.1392434356421),
            ("4", 4875465, 25.632756806933767),
            ("5", 4536819, 24.99926230774438),
            ("6", 4315217, 25.272968004742996),
            ("7", 4137254, 25.965600421725252),
            ("8", 3886222, 26.787498818894566),
            ("9", 3165513, 22.885657514313746),
            ("MT", 5787, 350.1119244963398),
            ("X", 2732834, 17.871078305790537),
            ("Y", 221760, 4.0985985753710485),
        ),
        "gap_weights": (
            0.058057740686776334, 0.03330718981331914, 0.05347251871345529, 0.046252995848813455, 0.10045221182443928, 0.09963913792558214,
            0.14220752454717836, 0.1598780895645946, 0.1423318380322702, 0.10361884819710723, 0.046660673486384315, 0.012240315528975402,
            0.0014991798810963899, 0.00015784541199159098, 7.034960958047183e-05, 5.1295095706748275e-05, 3.6114617033254664e-05, 2.443511831848736e-05,
            1.5840499485384644e-05, 9.78552595021044e-06, 6.384983941119715e-06, 4.2470904417335635e-06, 4.060562820981752e-06, 1.3774347378595341e-06,
        ),
        "sfs_weights": (
            9.857446523522332e-06, 0.372518783289673, 0.1537816647557115, 0.10090094481452488, 0.07881412745882022, 0.0638806933966853,
            0.05095525920909199, 0.03869482248483552, 0.030234797994647785, 0.03151657833095643, 0.030318871422848406, 0.029847397630723353,
            0.018526201764958148,
        ),
        "indel_weights": (
            0.41397845771447467, 0.1804996298650774, 0.0804643432114488, 0.10038899812624806, 0.0320866684994744, 0.07843860835183655,
            0.0680457858325089, 0.037027222475644446, 0.007075391239847958, 0.0019948946834387935,
        ),
        "variant_classes": {"snp": 0.8700686804540615, "insertion": 0.0575473064039899, "deletion": 0.07100477763140252, "mnp": 0.0, "complex": 2.727677725514863e-05, "symbolic": 0.0013519587332909034},
        "titv": 2.0563938643992925,
        "multiallelic_rate": 0.0,
        "missing_rate": 0.0001374522952447152,
        "phased_rate": 1.0,
        "payload": "gt-only",
        "ploidy": 2,
    },
    "germline-1kgp-unphased": {
        "source": "1000 Genomes unphased sites, chromosomes 21 and 22",
        "n_samples": 3202,
        "n_variants": 3501446,
        "fitted_on": "2026-07-16",
        "supplied": ["n_samples", "phased_rate", "ploidy"],
        # contig, variants, variants per kb
        "contigs": (
            ("chr21", 1691523, 40.593658159297135),
            ("chr22", 1809923, 44.91323782933475),
        ),
        "gap_weights": (
            0.09529575331109488, 0.05246154738171841, 0.08690051171466356, 0.07281725568955648, 0.14612920178433966, 0.12780252600517142,
            0.15502776927935574, 0.13533791919152044, 0.08356227671081459, 0.0355615784694945, 0.00748203817381521, 0.0009264650731302923,
            0.00021927984919961312, 0.00016870053095947732, 0.00013230809466474548, 7.833626117679569e-05, 3.9784951542545845e-05, 2.7448532459585892e-05,
            1.0794366697589957e-05, 5.242978110257979e-06, 2.775694293665989e-06, 1.542052385369994e-06, 8.018672403923968e-06, 9.252314312219964e-07,
        ),
        "sfs_weights": (
            0.35787300446729725, 0.22529206504969662, 0.09855299781861551, 0.06571228001231491, 0.05235179979928292, 0.04268008131497673,
            0.034741646736805305, 0.02745694207478853, 0.022306498515184868, 0.020540371035280853, 0.020678028448818, 0.02059177836813705,
            0.011222506358801478,
        ),
        "indel_weights": (
            0.35032270990454656, 0.17164684612485748, 0.08125468084395915, 0.09782665731690447, 0.033611441055950694, 0.0902323606718472,
            0.0876778720704476, 0.06410072937685743, 0.017473560685204, 0.0058531419494254186,
        ),
        "variant_classes": {"snp": 0.8802603267335838, "insertion": 0.053398224619200185, "deletion": 0.06634144864721604, "mnp": 0.0, "complex": 0.0, "symbolic": 0.0},
        "titv": 2.011833590981846,
        "multiallelic_rate": 0.0,
        "missing_rate": 0.007673441443754703,
        "phased_rate": 0.0,
        "payload": "gt-only",
        "ploidy": 2,
    },
    "somatic-gdc": {
        "source": "GDC somatic whole-genome genotypes",
        "n_samples": 16007,
        "n_variants": 348259675,
        "fitted_on": "2026-07-17",
        "supplied": ["ploidy"],
        # contig, variants, variants per kb
        "contigs": (
            ("1", 26141313, 105.01209062702047),
            ("10", 15617340, 116.74151381226785),
            ("11", 15937357, 118.04920069659688),
            ("12", 15704905, 117.85654885375615),
            ("13", 13167441, 133.87801807954608),
            ("14", 10651952, 117.23374269540629),
            ("15", 8548420, 100.59220456483777),
            ("16", 9069506, 100.52857077285952),
            ("17", 7809071, 93.8876745960934),
            ("18", 9795861, 122.06202772875928),
            ("19", 6261486, 107.00066693785297),
            ("2", 29751638, 122.85269949752585),
            ("20", 7505045, 116.76649454927004),
            ("21", 4525689, 108.61147557413005),
            ("22", 3459843, 85.85716674722138),
            ("3", 24417240, 123.1885334977822),
            ("4", 25030240, 131.60339049145546),
            ("5", 22965968, 126.55719474273647),
            ("6", 20299609, 118.93479941948154),
            ("7", 20239297, 127.03173256200132),
            ("8", 20168513, 139.0764972097453),
            ("9", 12427049, 89.8559022723338),
            ("MT", 7251, 440.38870331005165),
            ("PAR1", 300353, 108.37978263638631),
            ("PAR2", 39747, 121.0396491869176),
            ("X", 17901494, 117.06490053711107),
            ("Y", 516047, 9.537658815972385),
        ),
        "gap_weights": (
            0.14887580687077615, 0.10554785330676307, 0.17052041953625835, 0.13141381824674386, 0.1982697670322772, 0.11670432335578149,
            0.08284535995265192, 0.03419671254341539, 0.008924794096543304, 0.0018603277928120067, 0.00044921295262958843, 0.00018690691287872273,
            8.362848377299757e-05, 4.295598663209445e-05, 2.6585220156043244e-05, 1.9279310174597523e-05, 1.2887424184811605e-05, 8.71306719197353e-06,
            5.157482454657727e-06, 2.6918163603177054e-06, 1.3757474513642416e-06, 6.941556775148343e-07, 5.905034722750626e-07, 1.382029403196955e-07,
        ),
        "sfs_weights": (
            0.7417349320430052, 0.22432890938047953, 0.02365071378252424, 0.005660213428935623, 0.0023966751764086503, 0.001327393266791051,
            0.000761819616736008, 0.00013397622723101203, 5.148903990769743e-06, 2.0944694199741328e-07, 8.726955916558887e-09, 0.0,
            0.0, 0.0, 0.0,
        ),
        "indel_weights": (
            0.5817362979229688, 0.12304028635117434, 0.05088305726944896, 0.044487580512454855, 0.02378174393063462, 0.058905263556307326,
            0.0575280117845547, 0.04388563997410788, 0.011773080488547616, 0.003979038209800924,
        ),
        "variant_classes": {"snp": 0.908658816154928, "insertion": 0.03095976299868769, "deletion": 0.06038142084638424, "mnp": 0.0, "complex": 0.0, "symbolic": 0.0},
        "titv": 1.0650440955373117,
        "multiallelic_rate": 0.0,
        "missing_rate": 0.0,
        "phased_rate": 0.6380109462178213,
        "payload": "gt-vaf",
        "ploidy": 2,
    },
}
