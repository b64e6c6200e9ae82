"""Catalogues that operators take as data: patterns with weights, queries, labels."""

from __future__ import annotations

# The domain's patterns, weights, queries and labels, which results depend on.

PATTERNS: dict[str, list[tuple[str, float]]] = {
    "BREACH": [
        (r"(?i)zmluv[auúy]\s+o\s+(dielo|spolupráci|poskytovan|kúp|prenájm|obchodnom zastúpen|úver)", 3), (r"(?i)(leasingov|rámcov|abonentn)[áaéeúu]\s+zmluv", 3), (r"(?i)dohod[auúy]\s+o\s+užívan", 2),
        (r"(?i)zmluv[auúy]\s+o\s+(nájme|servisn|sprostredkovan)", 3), (r"(?i)kúpn[áaéeú]\s+zmluv", 3), (r"(?i)porušil[aio]?\s+(zmluvnú\s+)?povinnosť", 3), (r"(?i)porušeni[ae]\s+zmluvy", 3),
        (r"(?i)(nesplnil|neuhradil|nedodržal|nezaplatil|neposkytoval)[aio]?", 3), (r"(?i)v\s+omeškan[ií]", 2), (r"(?i)odstúpil[aio]?\s+(od\s+)?zmluvy", 2), (r"(?i)(konkurenčn[áéú]\s+doložk|zákaz[ue]?\s+konkurencie)", 2),
        (r"(?i)neplaten[ií][ae]?\s+(nájomného|splátok|leasingov)", 3), (r"(?i)faktúr[yuoa]\s+(neuhradil|nezaplatil)", 2), (r"(?i)(žalobca|žalobkyňa|žalovan[ýá])\s+(a\s+)?(žalobca|žalovan[ýá])?\s*(uzavreli|uzatvorili|uzavrela)", 3),
        (r"(?i)(zhotoviteľ|objednávateľ|prenajímateľ|nájomca|dodávateľ|odberateľ)", 1), (r"(?i)(navrhovateľ|odpor(?:ca|kyňa))", 1), (r"(?i)predmetom\s+zmluvy", 3), (r"(?i)predmetom\s+(konania|sporu)", 2),
        (r"(?i)na\s+základe\s+(vykonaného\s+)?dokazovania", 2), (r"(?i)(skutkov[ýé]\s+stav|skutkový\s+záver)", 1), (r"(?i)napadnutým\s+rozhodnutím", 2), (r"(?i)súd\s+prvej\s+inštancie", 1), (r"(?i)súd\s+prvého\s+stupňa", 1),
    ],
    "RATE": [
        (r"(?i)zmluvn[úu]\s+pokut[uú]\s+vo\s+výške", 4), (r"(?i)(povinný|povinná|zaviazal[ai]?\s+sa)\s+zaplatiť", 2), (r"\d+[.,]\d+\s*%", 2), (r"(?i)\d+\s*%\s*(denne|mesačne|ročne|za\s+každý\s+deň)", 4),
        (r"(?i)z\s+(dlžnej\s+)?sumy", 2), (r"(?i)z\s+(fakturovanej\s+)?cen[yuy]", 2), (r"(?i)vo\s+výške\s+[\d\s.,]+\s*(eur|€|sk)", 3), (r"(?i)\d+-?násobo?k", 3), (r"(?i)(čl\.|článo?k)\s+[IVXLC]+\.?\s*(bod|ods\.?)\s*\d+", 2),
        (r"(?i)(\d+\s*%\s*(zo\s+)?súčtu|mesačn[ýéého]+\s+paušál|mesačn[áéú]\s+(odmena|nájomné))", 3), (r"(?i)do\s+skončenia\s+účinnosti\s+zmluvy", 2), (r"(?i)(všeobecn[ýéých]+\s+zmluvn[ýéých]+\s+podmienok|VZP)", 2),
        (r"(?i)zmluvn\w+\s+pokut\w+\s+(vo\s+výške\s+)?(\d|dvakrát|trikrát)", 3), (r"(?i)\d+,\-?\s*(eur|€)", 2),
    ],
    "PRINCIPAL": [
        (r"(?i)[\d\s]+[.,]\d{2}\s*(eur|€|sk)", 3), (r"(?i)(istina|dlžná\s+suma|zostatok\s+dlhu|celkov[áé]\s+sum[auy])", 3), (r"(?i)(faktúr[ouya]|cen[auúy]\s+diela|cen[auúy]\s+zákazky)", 2),
        (r"(?i)(splatnosť|splatn[áé]|lehot[auúy]\s+splatnosti)", 2), (r"(?i)(vyúčtovanie|vyúčtoval)", 2), (r"(?i)(uhradiť|zaplatiť|splatiť)\s+(sumu|čiastku|cenu)", 2), (r"(?i)úver[u]?\s+vo\s+výške", 3),
        (r"(?i)(úrok[uy]?\s+(z\s+)?úveru|úrok\w*\s+vo\s+výške)", 2), (r"(?i)nájomné\s+(vo\s+výške\s+)?\d", 2), (r"(?i)dob[auúy]\s+trvania\s+zmluvy", 2), (r"(?i)(obdobie|po\s+dobu)\s+\d+\s+mesiacov", 2),
    ],
    "OUTCOME": [
        (r"§\s*301", 4), (r"(?i)moderačn[éeého]+\s+(oprávneni|práv)", 4), (r"(?i)(súd\s+)?(znížil|priznal|zamietol|zmenil|potvrdil|uložil|zaviazal)", 3), (r"(?i)(znížil|znížiť)\s+(zmluvnú\s+pokut|na\s+sumu)", 4),
        (r"(?i)(rozsudok|rozhodnutie)\s+(potvrdil|zmenil|zrušil)", 3), (r"(?i)žalob[eu]\s+(zamietol|v\s+celom\s+rozsahu)", 2),
    ],
    "REASONING": [
        (r"(?i)dospel\s+k\s+záveru", 3), (r"(?i)(nestotožnil|nestotožňuje)\s+sa", 3), (r"(?i)(prihliadol|s\s+prihliadnutím)\s+(na|k)", 3), (r"(?i)(považoval|považuje)\s+za\s+(preukázan|primeran|neprimeran)", 3),
        (r"(?i)s\s+ohľadom\s+na", 2), (r"(?i)je\s+(toho\s+)?názoru", 2), (r"(?i)(primeran[áéú]|neprimeran[áéú]|neprimerane\s+vysok)", 3), (r"(?i)zjavne\s+neprimeran", 4),
    ],
    "FACTORS": [
        (r"(?i)dobr[ýéeých]+\s+mrav", 4), (r"(?i)poctiv[ýéeých]+\s+obchodn[ýéeého]+\s+styk", 4), (r"(?i)hodnot[auúy]\s+a\s+význam[ue]?\s+zabezpečovan", 4), (r"(?i)výšk[auúy]\s+škod", 3), (r"(?i)(vzniknut[áé]\s+)?škod[auúy]", 2),
        (r"(?i)zabezpečovaci[aeu]?\s+funkci", 3), (r"(?i)(sankčn|reparačn|preventívn)[áéeú]\s+funkci", 3), (r"(?i)kumuláci[auúe]\s+(s\s+)?úrok", 3), (r"(?i)úrok\w*\s+z\s+omeškania", 2), (r"(?i)hospodársk[auúe]\s+pozíci", 3),
        (r"(?i)pomer\w*\s+(pokut|k\s+istin)", 3), (r"(?i)reciprocit", 2), (r"(?i)test\s+primeranosti", 3),
    ],
    "NOISE": [
        (r"(?i)trov[yoaú]\s+konania", -2), (r"(?i)náhrad[auúy]\s+trov", -2), (r"(?i)bez\s+nariadenia\s+pojednávania", -1), (r"(?i)v\s+zákonnej\s+lehote\s+(podal|podala)", -1), (r"(?i)prípustnosť\s+dovolania", -0.5),
        (r"(?i)dovolac[ýíieé]+\s+(súd|konani)", -0.5), (r"(?i)toto\s+(rozhodnutie|uznesenie)\s+prijal\s+senát", -2), (r"(?i)(žalovan[ýá]|žalobca|žalobkyňa)\s+(v\s+odvolaní\s+)?(uviedol|namietal|namiet[ao]l|tvrdil)", -1),
    ],
}

#: per query: pattern groups, bonus of the first chunk, position bonus, golden column, call, keywords
QUERY_GROUPS = {
    "q_breach": ["BREACH", "NOISE"], "q_contract": ["BREACH", "PRINCIPAL", "NOISE"], "q_rate": ["RATE", "NOISE"], "q_principal": ["PRINCIPAL", "RATE", "NOISE"],
    "q_outcome": ["OUTCOME", "REASONING", "NOISE"], "q_reasoning": ["REASONING", "OUTCOME", "NOISE"], "q_factors": ["FACTORS", "REASONING", "NOISE"],
}
FIRST_CHUNK_BONUS = {"q_breach": 3, "q_contract": 3, "q_rate": 0, "q_principal": 1, "q_outcome": 1, "q_reasoning": 0, "q_factors": 0}
POSITION_QUERIES = ("q_breach", "q_contract")
GOLD_COLUMN = {
    "q_breach": "q1_context_quotes", "q_contract": "q1_context_quotes", "q_rate": "q2_penalty_quotes", "q_principal": "q2_penalty_quotes",
    "q_outcome": "q3_moderation_quotes", "q_reasoning": "q3_moderation_quotes", "q_factors": "q3_moderation_quotes",
}
CALLS = {"call1": ["q_breach", "q_contract", "q_rate", "q_principal"], "call2": ["q_outcome", "q_reasoning", "q_factors"]}
KEYWORDS = {
    "q_breach": "zmluva uzatvorená predmet porušenie povinnosť záväzok dlžník zhotoviteľ objednávateľ žalovaný neuhradil nesplnil skutkový stav sporové strany napadnutým rozsudkom",
    "q_contract": "zmluva uzatvorená predmet zmluvy strany zmluvné podmienky článok zhotoviteľ objednávateľ nájomca prenajímateľ dodávateľ odberateľ žalobca žalovaný uzavreli dohoda",
    "q_rate": "zmluvná pokuta výška sadzba percentá ročne denne omeškanie eur suma článok bod zmluvy dohodnutá",
    "q_principal": "istina suma pohľadávka dlh záväzok eur faktúra cena dielo splatnosť uhradiť zaplatiť",
    "q_outcome": "zmluvná pokuta priznaná znížená zamietnutá moderácia moderačné oprávnenie §301 neplatnosť vrátená rozhodol uložil zaviazal",
    "q_reasoning": "primeranosť neprimeraná dôvod posúdenie zníženie argumenty súd záver odôvodnenie odvolací potvrdil zmenil",
    "q_factors": "dobré mravy škoda pomer istina úrok omeškanie kumulácia zabezpečovacia funkcia hodnota význam zabezpečovanej povinnosti",
}
STOPWORDS = (
    "a aj ak ako ale alebo ani áno asi by bol bola bolo boli buď byť bez do dňa ho jeho jej ich je ju keď keďže kde ku ktorý ktorá ktoré ktorej ktorým ktorom "
    "na nad nie no než od ods po pod podľa pre pri pred preto sa si so sú ten to tá tú tej tom tomu tým tento tiež tak takže vo vz za zo že"
).split()
FEATURES = {
    "has_penalty": r"\bzmluvn\w*\s+pokut\w*\b", "has_301": r"(?i)(?:(?:§|ss|par)\s*301\b)|(?:300\s*(?:až|-|do|a)\s*30[2-9])", "has_oz_545a": r"(?:§|ss|par)\s*545\s*a\b", "has_oz_544": r"(?:§|ss|par)\s*544\b",
    "has_moder_trig": r"(?i)\b(primeran\w*|neprimeran\w*|moder\w*|zniz\w*|poniz\w*|neprizna\w*|zamiet\w*)\b", "has_invalidity": r"(?i)\b(neplatn\w*|neurcit\w*|dobr\w*\s+mrav\w*|poctiv\w*\s+obchodn\w*\s+styk\w*)\b",
    "has_interest": r"\b(urok\w*|urok\s+z\s+omeskania|omeskan\w*)\b", "has_percent": r"(\d+(?:[.,]\d+)?)\s*%", "has_money": r"(\d{1,3}(?:[ \.]\d{3})*(?:,\d+)?|\d+(?:,\d+)?)\s*(eur|€|sk|sk\.)", "has_civil_code": r"(?i)obciansk\w*\s+zakonnik",
}
CONTRACTS = {
    "sale_purchase": r"\bkupn\w+\s+zmluv\w+", "work_contract": r"\bzmluv\w+\s+o\s+diel\w+", "lease": r"\bnajomn\w+\s+zmluv\w+", "loan_credit": r"\b(uverov\w+|zmluv\w+\s+o\s+uvere|pozick\w+)", "leasing": r"\bleasing\w*|lizing\w*",
    "mandate": r"\bmandatn\w+\s+zmluv\w+|\bprikazn\w+\s+zmluv\w+", "agency": r"\bsprostredkovate[l]\w+\s+zmluv\w+", "insurance": r"\bpoistn\w+\s+zmluv\w+",
}
FACTOR_LABELS = ["dobre_mravy", "zabezpecovacia_funkcia", "vyska_skody", "pomer_k_istine", "spravanie_dlznika", "kumulacia_s_urokom", "spravanie_veritela"]
FACTOR_NAMES = {
    "dobre_mravy": "dobre mravy", "zabezpecovacia_funkcia": "zabezpecovacia funkcia pokuty", "vyska_skody": "vyska skutocnej skody", "pomer_k_istine": "pomer pokuty k istine",
    "spravanie_dlznika": "spravanie dlznika", "kumulacia_s_urokom": "kumulacia s urokom z omeskania", "spravanie_veritela": "spravanie veritela",
}
DECISION_LABELS = {"awarded_full": "Potvrdena v plnej vyske", "moderated_301": "Znizena podla §301", "dismissed": "Zamietnuta", "returned": "Vratena na doplnenie", "unclear": "Nejasne"}
SIMILAR_CONTRACTS = {"dielo": ["dodavka_sluzieb"], "dodavka_sluzieb": ["dielo"], "uver": ["pozicka"], "pozicka": ["uver"]}
CHUNK_PRESETS = {"me5_200": (200, 25), "me5_380": (380, 50), "openai_200": (200, 25), "openai_380": (380, 50), "openai_500": (500, 75)}
