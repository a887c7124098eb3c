"""Labelled cases and what became of them in a recorded run, as result lines."""

#: Row, previous and current position, current, target and detected road, result, iterations, alternative, city.
RESULTS = """\
1;"38.016959,24.419875";"38.016989,24.419658";Gerestou;Theoxari Kotsika;Theochari Kotsika;PASS;0;NO;Karystos
2;"37.956799,23.698016";"37.956881,23.698128";Kremou;Filaretou;Filaretou;PASS;0;NO;Athens
3;"37.957598,23.697048";"37.957678,23.697065";Mystra;Akropoleos;Akropoleos;PASS;0;NO;Athens
4;"37.957836,23.696352";"37.957891,23.696286";Fornezi;P Tsaldari;Panagi Tsaldari;PASS;0;NO;Athens
5;"37.999473,23.744309";"37.999508,23.744258";Skopelou;Kaukasou;Kafkasou;PASS;0;NO;Athens
6;"37.999597,23.744134";"37.999635,23.744086";Skopelou;Kaukasou;Kafkasou;PASS;0;NO;Athens
7;"37.999703,23.743989";"37.999747,23.743934";Skopelou;Kaukasou;Kafkasou;PASS;0;NO;Athens
8;"37.988891,23.741949";"37.988988,23.741867";Vatatzi;Frantzi;Frantzi;PASS;0;NO;Athens
9;"37.989086,23.741556";"37.989059,23.741502";Frantzi;Komninwn;Komninon;PASS;0;NO;Athens
10;"38.009227,23.677565";"38.009143,23.677531";Mparouzi;Thiamidos;Thiamidos;PASS;0;NO;Athens
11;"38.008431,23.677677";"38.008545,23.677751";Kavafi;Thiamidos;Thiamidos;PASS;0;NO;Athens
12;"38.008428,23.676945";"38.00845,23.67688";Griva;Thlemaxou;Tilemachou;PASS;0;NO;Athens
13;"37.956906,23.699067";"37.957027,23.698934";Filaretou;Kremou;Kremou;PASS;0;NO;Athens
14;"38.044616,23.676898";"38.044726,23.676985";K Palama;25 Martiou;25is Martiou;PASS;0;NO;Athens
15;"38.046277,23.676648";"38.046444,23.676762";Souliou;Dwdekanisou;Dodekanisou;PASS;0;NO;Athens
16;"38.047573,23.676845";"38.047743,23.676959";Olimpias;Elli;Olimpias / UNKNOWN;FAIL;0;NO;Athens
17;"38.048403,23.678203";"38.048547,23.678317";Souliou;Maniakiou;Maniakiou;PASS;0;NO;Athens
18;"38.035455,23.686291";"38.035588,23.686377";Kolokotreno;Alamanas;Alamanas;PASS;0;NO;Athens
19;"38.0358,23.68576";"38.035686,23.685685";Ag Glikerias;Karaoli k Dimitriou;Karaoli ke Dimitriou;PASS;0;NO;Athens
20;"38.036324,23.684298";"38.036383,23.684379";Eptanisou;Kiafas;Kiafas;PASS;0;NO;Athens
21;"38.035804,23.68238";"38.035905,23.682249";Jathnou;Arxipelagous;Archipelagous;PASS;0;NO;Athens
22;"38.035183,23.681353";"38.035136,23.681401";Tsakalof;Stereas Elladas;Stereas Ellados;PASS;0;NO;Athens
23;"38.030905,23.681438";"38.030986,23.681343";Kronou;Mouswn;Mouson;PASS;0;NO;Athens
24;"38.031963,23.680601";"38.031779,23.680373";Iakinthou;Vasilikwn;Vasilikon;PASS;0;NO;Athens
25;"38.031544,23.680064";"38.031381,23.679852";Iakinthou;Vasilikwn;Vasilikon;PASS;0;NO;Athens
26;"38.031759,23.67738";"38.031844,23.677484";Antheon;Elaiwn;Eleon;PASS;0;NO;Athens
27;"38.03215,23.676661";"38.032278,23.676494";Mileas;Foinikwn;Finikon;PASS;0;NO;Athens
28;"38.031898,23.676163";"38.031978,23.67607";Kipoupoleos;Foinikwn;Finikon;PASS;0;NO;Athens
29;"38.032253,23.674978";"38.03236,23.674841";Peukwn;Athinas;Athinas;PASS;0;NO;Athens
30;"38.03126,23.67388";"38.031375,23.67374";Krinon;Athinas;Athinas;PASS;0;NO;Athens
31;"38.030801,23.67365";"38.030899,23.673539";Gardenias;Athinas;Athinas;PASS;0;NO;Athens
32;"38.03089,23.672265";"38.030977,23.672391";Athinas;Rodwn;Rodon;PASS;0;NO;Athens
33;"38.031098,23.671611";"38.031207,23.67174";Naidwn;Rodwn;Rodon;PASS;0;NO;Athens
34;"38.031917,23.671604";"38.032024,23.671478";Rodwn;Akakias;Akakias;PASS;0;NO;Athens
35;"37.988226,23.724572";"37.988183,23.724836";Konstadinou Palaiologou;Sonierou;Sonierou;PASS;0;NO;Athens
36;"37.989139,23.727275";"37.989198,23.72691";Averof;Acharnon;Ἀcharnon;PASS;0;YES;Athens
37;"37.990383,23.728028";"37.990426,23.727739";Ipeirou;Filis;Filis;PASS;0;NO;Athens
38;"37.990581,23.732561";"37.990566,23.732668";Metsovou;Rethimnou;Rethimnou;PASS;0;NO;Athens
39;"37.987631,23.737356";"37.987658,23.737329";Kalidromiou;Themistokleous;Ersis / Zosimadon;FAIL;0;NO;Athens
40;"37.98583,23.734096";"37.985862,23.734066";Tzavella;Themistokleous;Themistokleous;PASS;0;NO;Athens
41;"37.982196,23.735299";"37.982146,23.735342";Solonos;Asklipiou;Solonos / Solonos;FAIL;0;NO;Athens
42;"37.981784,23.737087";"37.981747,23.737009";Massalias;Skoufa;Massalias / Massalias;FAIL;0;NO;Athens
43;"37.978119,23.740486";"37.978215,23.74042";Tsakalof;Irakleitou;Iraklitou;PASS;0;NO;Athens
44;"37.977301,23.743434";"37.977326,23.743537";Alopekis;Loukianou;Loukianou;PASS;0;NO;Athens
45;"37.964163,23.748121";"37.964088,23.748005";Filolaou;Olimpiados;Olimpiados;PASS;0;YES;Athens
46;"37.963267,23.749297";"37.963362,23.749207";Alketou;Iliados;Iliados;PASS;0;NO;Athens
47;"37.961302,23.748012";"37.96137,23.747938";Kontoliou;Filoktitou;Filoktitou;PASS;0;NO;Athens
48;"37.960696,23.746717";"37.9606,23.74657";Charidimou;Eumenous;Evmenous;PASS;0;NO;Athens
49;"37.959574,23.742855";"37.959437,23.742814";Agiou Artemiou;Megasthenous;Megasthenous;PASS;0;NO;Athens
50;"37.956539,23.767544";"37.95648,23.767392";Aiolou;Thiseos;Thiseos;PASS;0;NO;Athens
51;"38.09362,23.81852";"38.09355,23.818673";Smirnis;Efesou;Efesou;PASS;0;NO;Athens
52;"38.034345,23.836342";"38.034415,23.836243";Pindou;Salaminos;Salaminos;PASS;0;NO;Athens
53;"38.028325,23.817542";"38.028177,23.81741";Artemisiou;Pellis;Pellis;PASS;0;NO;Athens
54;"38.017602,23.829854";"38.017696,23.829774";Tinou;Kanari;Kanari;PASS;0;NO;Athens
55;"37.989598,23.721817";"37.989588,23.72188";Kritis;Chiou;Psaron / Agiou Pavlou;FAIL;0;NO;Athens
56;"37.989764,23.720821";"37.989733,23.721013";Kritis;Samou;Samou;PASS;0;NO;Athens
57;"37.985697,23.727428";"37.98572,23.727323";Veranzerou;Sokratous;Sokratous;PASS;0;NO;Athens
58;"37.981223,23.72619";"37.981238,23.726091";Sofokleous;Sokratous;Geraniou / Platia Theatrou;FAIL;0;NO;Athens
59;"37.979845,23.72793";"37.979791,23.727913";Filopoimenos;Euripidou;Evripidou;PASS;0;NO;Athens
60;"37.975402,23.72821";"37.975428,23.728108";Pandrosou;Kapnikareas;Kapnikareas;PASS;0;NO;Athens
61;"37.975221,23.732593";"37.975235,23.732469";Mitropoleos;Voulis;Voulis;PASS;0;NO;Athens
62;"37.964514,23.748723";"37.964464,23.748635";Filolaou;Alketou;Alketou;PASS;0;YES;Athens
63;"37.968368,23.745345";"37.968314,23.745335";Nikosthenous;Eutichidou;Eftichidou;PASS;0;NO;Athens
64;"37.966921,23.741744";"37.967035,23.741964";Archimidous;Empedokleous;Protagorou / UNKNOWN;FAIL;0;NO;Athens
65;"37.955511,23.706632";"37.955371,23.706406";Sofokleous;Ifigeneias;Ifigeneias;PASS;0;NO;Athens
66;"37.95111,23.701234";"37.951048,23.701287";Chiou;Andromachis;Andromachis;PASS;0;YES;Athens
67;"37.949665,23.700907";"37.949513,23.700713";Dimosthenous;Spartis;Spartis;PASS;0;YES;Athens
68;"37.949773,23.695461";"37.94969,23.695572";Athinas;Ksenofontos;Xenofontos;PASS;0;NO;Athens
69;"40.601311,22.951784";"40.601347,22.951966";Koromila;Kimonos Boga;Kimonos Voga;PASS;0;NO;Thessaloniki
70;"40.601674,22.95237";"40.601749,22.952322";Kimonos Bog;Kriezotou;Kriezotou;PASS;0;NO;Thessaloniki
71;"40.602193,22.951376";"40.602226,22.951592";Maurokordatou;Kimonos Boga;Kimonos Voga;PASS;0;NO;Thessaloniki
72;"40.604217,22.958426";"40.604311,22.958387";Delfwn;Petrou Sindika;Petrou Sindika;PASS;0;YES;Thessaloniki
73;"40.604926,22.961383";"40.604781,22.961441";I Kondilaki;Miltiadou Malakasi;Miltiadi Malakasi;PASS;0;NO;Thessaloniki
74;"40.605767,22.961166";"40.605781,22.96125";Sot Skipi;Gamvetta;Gambetta;PASS;0;NO;Thessaloniki
75;"40.606265,22.960961";"40.606305,22.96113";Artemidos;Gamvetta;Gambetta;PASS;0;NO;Thessaloniki
76;"40.607301,22.961117";"40.607426,22.961065";Gamvetta;Tompazi;Tompazi;PASS;0;NO;Thessaloniki
77;"40.607866,22.960661";"40.607863,22.960492";Tompazi;Solonos;Solonos;PASS;0;NO;Thessaloniki
78;"40.607447,22.960115";"40.607575,22.960158";Solonos;Tompazi;Tompazi;PASS;0;NO;Thessaloniki
79;"40.607853,22.959869";"40.607851,22.959664";Tompazi;Makedonias;Makedonias;PASS;0;NO;Thessaloniki
80;"40.608654,22.958354";"40.608546,22.958383";Stamatiou;Tompazi;Tompazi;PASS;0;YES;Thessaloniki
81;"40.607824,22.957962";"40.607815,22.957795";Tompazi;Delfon;Delfon;PASS;0;NO;Thessaloniki
82;"40.60868,22.956175";"40.608658,22.956374";Andreopoulou;Mikinwn;Mikinon;PASS;0;NO;Thessaloniki
83;"40.608559,22.956913";"40.608511,22.957204";Andreopoulou;Delfon;Delfon;PASS;0;NO;Thessaloniki
84;"40.608269,22.956063";"40.608422,22.956054";Xalkidikis;Andreopoulou;Andreopoulou;PASS;0;NO;Thessaloniki
85;"40.609322,22.954691";"40.609339,22.954599";Kosma;Androutsou;Kosma tou Εtolou / Orestou;FAIL;0;NO;Thessaloniki
86;"40.609805,22.954736";"40.609798,22.954951";Orestou;Mouzoukiou;Mouzakiou;PASS;0;NO;Thessaloniki
87;"40.622386,22.9734";"40.622351,22.973152";Athanasiou D;Ipsilantou;Ipsilantou;PASS;0;NO;Thessaloniki
88;"40.622364,22.973275";"40.622386,22.973445";Athanasiou D;Karaiskaki;Karaiskaki;PASS;0;NO;Thessaloniki
89;"40.622687,22.974248";"40.622813,22.974355";Miaouli;Agiou Spiridonos;Agiou Spiridonos;PASS;0;NO;Thessaloniki
90;"40.624313,22.973816";"40.624462,22.973857";Kolokotroni;Riga Feraiou;Riga Fereou;PASS;0;NO;Thessaloniki
91;"38.228633,21.745021";"38.228702,21.745072";Oropou;Maurovouniou;Mavrovouniou;PASS;0;NO;Patra
92;"38.230141,21.751808";"38.230054,21.751927";Kox;Arginouson;Arginouson;PASS;0;YES;Patra
93;"38.235337,21.742755";"38.235331,21.742914";Pontou;Fanariou;Fanariou;PASS;0;NO;Patra
94;"38.236384,21.744146";"38.236375,21.744022";Fwkaias;Fanariou;Fanariou;PASS;0;NO;Patra
95;"38.238264,21.743428";"38.238335,21.743307";Karatza;Danailidos;Daniilidos;PASS;0;YES;Patra
96;"38.238412,21.742437";"38.238484,21.742495";Kwn Palaiologou;Karatza;Karatza;PASS;0;NO;Patra
97;"38.238992,21.742829";"38.239104,21.742909";Kwn Palaiologou;Dim Gounari;Dimitriou Gounari;PASS;0;NO;Patra
98;"38.242414,21.741497";"38.242457,21.74138";Pantokratoros;Lontou;Lontou;PASS;0;NO;Patra
99;"38.247023,21.736722";"38.247105,21.736813";Korinthou;Agiou Nikolaou;Korinthou / Korinthou;FAIL;0;NO;Patra
100;"38.24717,21.739063";"38.24725,21.738974";Kolokotroni;Kanakari;Kanakari;PASS;0;NO;Patra
"""
