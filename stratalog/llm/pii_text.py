"""A batch of texts as one array of characters, its words, and where words of a kind stand: what the generators look at.

The texts are joined by a character that no mention can contain, so every look at the whole batch is one pass of numpy or of
one regular expression, whatever the number of texts.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import regex

#: Stands between texts; it ends a sentence and every mention.
SEPARATOR = "\0"
#: Characters of context looked at to the left and to the right.
LEFT, RIGHT = 80, 50
#: What a distance is when there is nothing within reach.
FAR = 99.0

LETTER, UPPER, LOWER, DIGIT, EAST, SPACE, MARK, CASELESS = (1 << i for i in range(8))
#: Dashes and spaces, beside full-width forms, that are replaced one for one so that offsets stay.
_FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict.fromkeys([0x3000, 0xA0, 0x2007, 0x2009, 0x202F], 32) | dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013, 0x2212], 45)

#: Words that tell what stands beside them, by kind and language (en, de, fr, es).
CUES = {
    "closing": "regards sincerely yours faithfully cheers signed love best thanks thank thx ps grüße gruß grüßen hochachtungsvoll gez gezeichnet danke vielen cordialement salutations sincères amitiés signé merci bien saludos saludo atentamente cordialmente firmado gracias abrazo",
    "title": "mr mrs ms miss mister dr doctor prof professor sir madam herr herrn frau fräulein familie dipl monsieur madame mademoiselle mme mlle docteur señor señora señorita sr sra srta don doña doctor doctora",
    "relation": "wife husband mother father mum mom dad son daughter brother sister in-law brother-in-law sister-in-law uncle aunt cousin nephew niece friend neighbour neighbor colleague partner boss landlord tenant grandfather grandmother "
    "mann ehefrau ehemann mutter vater sohn tochter bruder schwester onkel tante cousin freund freundin nachbar nachbarin kollege kollegin schwager schwägerin chef vermieter oma opa "
    "mari femme épouse époux mère père fils fille frère soeur sœur oncle tante cousine ami amie voisin voisine collègue beau-frère belle-soeur belle-sœur patron gendre "
    "esposa marido mujer esposo madre padre hijo hija hermano hermana tío tía primo prima amigo amiga vecino vecina compañero compañera cuñado cuñada jefe yerno",
    "speech": "spoke speak speaking talked talking talk called asked ask met wrote written told answered said contacted contact emailed mailed sold helped dealt named name called surname "
    "gesprochen sprach telefoniert telefonierte geredet gefragt fragen heißt heiße heisse name namens schrieb geschrieben verkauft kontaktieren "
    "parlé parler discuté appelle m'appelle s'appelle demandez demander contacté contactez nom écrit vendu rappelez appelez "
    "hablé hablar habló llamo llama llamado pregunten pregunté preguntar contacté contacten nombre escribió vendió avisen avise",
    "service": "from of by with for technician engineer driver courier manager assistant seller agent clerk staff adviser advisor plumber electrician installer consultant customer client recipient owner buyer attn c/o "
    "von vom mit bei für durch techniker monteur fahrer bote verkäufer verkäuferin berater beraterin mitarbeiter mitarbeiterin kunde kundin empfänger inhaber "
    "de du par avec chez pour technicien livreur vendeur vendeuse conseiller conseillère responsable client cliente destinataire propriétaire "
    "por con para técnico repartidor vendedor vendedora asesor asesora encargado encargada cliente destinatario propietario atendió atendida atendido",
    "self": "i me my i'm am we us ich mir mein meine bin wir uns je moi mon ma mes suis nous yo mi mis soy me nosotros",
    "phone": "call phone telephone tel ring mobile cell reach reached fax whatsapp sms text number dial ruf rufen anruf anrufen telefon handy rückruf mobil erreichbar erreichen nummer appeler appelez tél téléphone portable joindre joignable numéro teléfono móvil llamar llame llámame llamen número",
    "mail": "email e-mail mail write writing address copy schreiben mailen adresse écrire écrivez courriel correo escribir escribid escríbeme dirección",
    "id": "passport ssn nino social security insurance tax licence license identity id i.d identification national taxpayer permit document ausweis personalausweis reisepass pass steuer-id steuer steuernummer steueridentifikationsnummer sozialversicherungsnummer "
    "rentenversicherungsnummer führerschein ausweisnummer passnummer passeport identité sécurité sociale fiscal permis carte nir pasaporte dni nie nif cif identidad seguridad social fiscal carné permiso documento",
    "goods": "order orders invoice part parts item serial barcode ref reference sku model tracking receipt article batch version product catalogue bestellung bestellnummer rechnung rechnungsnummer artikel artikelnummer seriennummer strichcode teil modell sendung sendungsnummer "
    "auftragsnummer commande facture article série code-barres référence pièce modèle suivi colis pedido factura artículo serie barras referencia pieza modelo seguimiento código",
    "place": "live lives living lived address street delivered deliver delivery deliveries moved move house home flat door parcel return send sent wohne wohnt wohnen anschrift adresse geliefert lieferung zugestellt umgezogen haus paket rücksendung zurück zurücksenden "
    "habite habitons adresse livré livraison déménagé maison colis renvoyer retour vivo vive vivimos dirección entregado entrega mudado casa paquete devolver devolución domicilio",
    "day": "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday christmas easter januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag weihnachten ostern "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche noël pâques enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo navidad",
}
#: The same for Japanese, whose words are not set apart.
EAST_CUES = {
    "title": "さん|様|さま|氏|くん|君|ちゃん|先生|殿", "relation": "妻|夫|母|父|息子|娘|兄|弟|姉|妹|友人|隣人|同僚|上司", "speech": "話し|話を|聞い|名前|氏名|申し|連絡", "service": "担当|店員|技術者|配達員|宛|から|より", "self": "私|僕|わたし",
    "phone": "電話|携帯|番号は|ファックス|連絡先", "mail": "メール|アドレス", "id": "旅券|パスポート|免許|マイナンバー|個人番号|保険証|在留カード|身分証", "goods": "注文|請求書|型番|製造番号|品番|シリアル|バーコード|追跡|商品番号|伝票", "place": "住所|返品先|送り先|届け先|配送先|住んで|引っ越",
}
KINDS_OF_CUES = list(CUES)
_EAST_CUES = {k: regex.compile(v) for k, v in EAST_CUES.items()}
_CUE_WORDS: dict[str, int] = {}
for _i, _k in enumerate(KINDS_OF_CUES):
    for _w in CUES[_k].split():
        _CUE_WORDS[_w] = _CUE_WORDS.get(_w, 0) | 1 << _i

#: Words of a family name that stand before it.
PARTICLES = frozenset("von van der den zu de del della di da dos das du des la las los le el al bin ibn ben ter ten af av".split())
#: Digits as words (en, de, fr, es), and words for repeated ones.
DIGIT_WORDS = frozenset("zero oh one two three four five six seven eight nine null eins zwei zwo drei vier fünf sechs sieben acht neun zéro un deux trois quatre cinq sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve double triple".split())
#: Kinds of streets that follow the name, that come before it, and that end a word (en; fr, es, it; de, nl, sv).
AFTER = frozenset("street st road rd lane ln row avenue ave av drive dr close court ct way terrace square sq place pl boulevard blvd crescent mews hill gardens parade grove walk path park circle quay green highway hwy alley trail view rise loop wharf embankment straße strasse str weg gasse platz allee ring damm ufer".split())
BEFORE = frozenset("rue avenue av boulevard bd chemin place quai impasse allée cours route square passage sentier faubourg esplanade calle c avda avenida plaza pza paseo pº camino ronda travesía carretera pasaje glorieta carrer via viale piazza corso largo vicolo".split())
ENDING = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "chaussee", "steig", "stieg", "graben", "markt", "straat", "laan", "plein", "gatan", "vägen")


#: Common given names, of English and other countries, German, French and Spanish; a feature of a word, never a condition.
GIVEN = {
    "en": "Oliver Charlotte Henry Sophia Jack Grace Samuel Hannah Benjamin Olivia Lucas Ava Ethan Mia Noah Chloe Adam Julia Simon Alice Peter Helen Ruth Diana Frank Rose Walter Joan Vera Igor Natasha Dmitri Svetlana Chen Yuki Hiroshi Ravi Anjali Sanjay Ibrahim Leila Chinedu Ngozi James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Susan Richard Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Betty Mark Emily Paul Ashley Steven Donna Andrew Michelle Kevin Carol Brian Amanda George Deborah Edward Laura Rajesh Priya Ahmed Fatima Wei Mei Kwame Amara Omar Yusuf".split(),
    "de": "Karl Erika Heinz Helga Werner Gisela Bernd Silke Ralf Anja Markus Katrin Tobias Julia Sebastian Franziska Florian Johanna Moritz Sophie Maximilian Clara Emil Frieda Otto Wilhelm Anneliese Rüdiger Hans Ursula Peter Monika Klaus Petra Wolfgang Sabine Jürgen Renate Stefan Claudia Andreas Birgit Thomas Gabriele Michael Heike Dieter Ingrid Uwe Jutta Lukas Lena Jonas Hannah Felix Leonie Björn Jörg Käthe Günther Mehmet Ayşe Svenja Torsten".split(),
    "fr": "Jacques Monique Louis Françoise Claude Jacqueline Christophe Valérie Olivier Sophie Éric Véronique Laurent Stéphanie Guillaume Élodie Maxime Manon Hugo Léa Lucas Emma Gérard Yvette Mamadou Aïcha Didier Brigitte Pierre Marie Jean Nathalie Michel Isabelle Philippe Sylvie Alain Catherine Nicolas Céline Julien Aurélie Thomas Camille Antoine Chloé Benoît Hélène Rémi Zoé François Sandrine Étienne Mathilde Loïc Noémie".split(),
    "es": "Luis Cristina Jesús Mercedes Fernando Beatriz Alejandro Silvia Diego Patricia Álvaro Sara Pablo Laura Adrián Alba Hugo Sofía Enrique Rocío Ramón Inés Emilio Consuelo Guadalupe Ernesto Ximena Leandro Antonio María José Carmen Manuel Ana Francisco Isabel Juan Dolores Javier Pilar Carlos Teresa Miguel Lucía Rafael Elena Pedro Rosa Ángel Marta Sergio Paula Andrés Raquel Íñigo Begoña Joaquín Nuria".split(),
}
#: Common family names.
FAMILY = {
    "en": "Lewis Harris Baker Turner Phillips Campbell Parker Edwards Collins Stewart Morris Rogers Reed Cook Morgan Bell Murphy Bailey Cooper Richardson Cox Howard Ward Peterson Gray Watson Brooks Kelly Sanders Price Bennett Sharma Gupta Reddy Suzuki Tanaka Lee Park Petrov Sokolova Nowak Jansen Silva Santos Costa Adeyemi Diallo Yilmaz Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker White Roberts Green Hall Wood Jackson Clarke Patel Khan Singh Kaur Chen Wang Nguyen Kim Okafor Mensah Hassan Ali O'Brien O'Connor McDonald MacLeod Fitzgerald Ivanov Kowalski Novak Andersson Rossi Haddad".split(),
    "de": "Huber Fuchs Peters Scholz Möller Weiß Jung Hahn Schubert Vogel Friedrich Keller Günther Frank Berger Winkler Roth Beck Lorenz Baumann Franke Albrecht Schuster Simon Ludwig Böhm Winter Kraus Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Hartmann Lange Werner Krause Lehmann Köhler Yılmaz".split(),
    "fr": "Thomas Robert Richard Petit Leroux Garnier Robin Clément Henry Masson Marchand Renaud Noël Meyer Dumas Brunet Blanchard Giraud Rivière Arnaud Lemaire Caron Benali Traoré Nguyen Petitjean Barbier Picard Martin Bernard Dubois Durand Moreau Laurent Simon Michel Lefebvre Leroy Roux Girard Bonnet Dupont Lambert Fontaine Rousseau Vincent Faure Mercier Blanc Guérin Boyer Chevalier Lefèvre Gauthier Perrin Morin".split(),
    "es": "Ortiz Rubio Marín Sanz Iglesias Medina Garrido Cortés Castillo Santos Lozano Guerrero Cano Prieto Méndez Cruz Calvo Gallego Vidal León Márquez Herrera Peña Flores Cabrera Campos Vega Fuentes Carrasco Reyes García González Rodríguez Fernández López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Alonso Gutiérrez Navarro Torres Domínguez Vázquez Ramos Gil Serrano Núñez".split(),
}
_PUBLIC_GIVEN = frozenset(w.lower() for x in GIVEN.values() for w in x)
_PUBLIC_FAMILY = frozenset(w.lower() for x in FAMILY.values() for w in x)


#: Last words of the prepositions that German streets have before them.
PREPOSITIONS = frozenset("am im zum zur der den".split())


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flags, fold, lower = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32), np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            east = 0x3005 <= i <= 0x30FF or 0x3400 <= i <= 0x9FFF or 0xF900 <= i <= 0xFAFF or 0xFF66 <= i <= 0xFF9F
            flags[i] = EAST if east else LETTER | (UPPER if c.isupper() or kind == "Lt" else LOWER if c.islower() else CASELESS)
        elif kind[0] == "M":
            flags[i] = MARK
        elif kind == "Nd":
            flags[i] = DIGIT
        elif c.isspace():
            flags[i] = SPACE
        low = c.lower()
        if len(low) == 1 and not 0xD800 <= i <= 0xDFFF:
            lower[i] = ord(low)
    for a, b in _FOLD.items():
        fold[a] = b
    flags[0x30FC] = EAST
    flags[0xFFFF] = 0
    return flags, fold, lower


FLAGS, FOLD, LOWERED = _tables()


class Lexicon:
    """What is known of single words, remembered: whether one is like a given name, how usual it is in either case, and what
    it tells of its neighbours.

    Given names are learned as beginnings and ends: a word counts as like one if it is listed, or splits into a beginning and
    an end that each occur in several listed names. How usual a word is comes from the ranks of public vocabularies: a
    word that is one token in small letters is a word of the language, a token only when capitalised rather a name or, in
    German, a noun.
    """

    #: Columns of the table of words.
    LISTED, LIKE, SMALL, CAPITAL, PARTICLE, BRAND, CUE, STREET, NUMBER, SPECIAL, PREPOSITION, COMMON_GIVEN, COMMON_FAMILY = range(13)
    MOST = 300_000
    #: While the models are trained, four in ten of the common names count as unknown, so that they learn to do without.
    learning = False

    def __init__(self, given: list[str | None], brands: list[str | None], ranks: list[dict[bytes, int]] = (), least: int = 3):
        self.given = frozenset(g.lower() for g in given if g)
        self.brands = frozenset(w for b in brands if b for w in regex.findall(r"[\p{L}\p{M}'’-]+", b.lower()))
        self.ranks = list(ranks)
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for g in self.given:
            for i in range(3, len(g) - 1):
                first[g[:i]] = first.get(g[:i], 0) + 1
                last[g[i:]] = last.get(g[i:], 0) + 1
        self._first = frozenset(x for x, n in first.items() if n >= least)
        self._last = frozenset(x for x, n in last.items() if n >= least)
        self._reset()

    def _reset(self) -> None:
        self._codes: dict[str, int] = {}
        self._rows: list[tuple] = []
        self._table = np.zeros((0, 13), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_codes", "_rows", "_table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def learn(self, learning: bool) -> None:
        self.learning = learning
        self._reset()

    def like_given(self, word: str) -> bool:
        parts = [p for p in word.split("-") if p]
        return bool(parts) and all(p in self.given or any(p[:i] in self._first and p[i:] in self._last for i in range(3, min(len(p) - 1, 40))) for p in parts)

    def usual(self, word: str) -> float:
        """Logarithm of the least rank of a word in the vocabularies, 17 if it is no token."""
        token = f" {word}".encode("utf-8", "replace")
        return min((np.log2(2 + r[token]) for r in self.ranks if token in r), default=17.0)

    def _row(self, word: str) -> tuple:
        street = (1 if word in AFTER else 0) | (2 if word in BEFORE else 0) | (4 if word.endswith(ENDING) and len(word) > 5 else 0)
        special = "'" in word or "’" in word or "-" in word or not word.isascii()
        whole = self.usual(word), self.usual(word.capitalize())
        hidden = self.learning and zlib.crc32(word.encode("utf-8", "replace")) % 10 < 4
        return (
            word in self.given, self.like_given(word), *whole, word in PARTICLES, word in self.brands, _CUE_WORDS.get(word, 0), street, word in DIGIT_WORDS, special, word in PREPOSITIONS,
            not hidden and word in _PUBLIC_GIVEN, not hidden and word in _PUBLIC_FAMILY,
        )

    def rows(self, words: list[str]) -> np.ndarray:
        """The table's rows of these words, in lower case."""
        codes = self._codes
        if len(codes) > self.MOST:
            self._reset()
            codes = self._codes
        for w in set(words).difference(codes):
            codes[w] = len(self._rows)
            self._rows.append(self._row(w))
        if len(self._table) < len(self._rows):
            self._table = np.concatenate([self._table, np.array(self._rows[len(self._table) :], np.float32)])
        return self._table[np.fromiter(map(codes.__getitem__, words), np.int64, len(words))]


class Batch:
    """Texts, joined and folded, and their words. Positions are places in the joined text."""

    def __init__(self, texts: list[str | None], lexicon: Lexicon):
        self.lexicon, texts = lexicon, [t or "" for t in texts]
        joined = SEPARATOR + SEPARATOR.join(texts) + SEPARATOR
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        #: Where each text begins.
        self.begins = np.concatenate([[1], 1 + np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points = np.where(points < 0x10000, FOLD[np.minimum(points, 0xFFFF)], points)
        near = np.minimum(self.points, 0xFFFF)
        self.flags = FLAGS[near]
        low = np.where(self.points < 0x10000, LOWERED[near], self.points)
        self.text = self.points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        self.lower = low.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        self._find_words()
        self._find_breaks()
        self._find_east()
        self._find_cues()
        self.digits = np.concatenate([[0], np.cumsum(self.flags & DIGIT != 0)])
        self.uppers = np.concatenate([[0], np.cumsum(self.flags & UPPER != 0)])
        self.letters = np.concatenate([[0], np.cumsum(self.flags & LETTER != 0)])

    def _find_words(self) -> None:
        letter = self.flags & (LETTER | MARK) != 0
        joint = (self.points == 0x27) | (self.points == 0x2019) | (self.points == 0x2D)
        inner = joint & np.roll(letter, 1) & np.roll(letter, -1)
        edge = np.diff((letter | inner).astype(np.int8))
        #: First character of each word, and the one after it.
        self.starts, self.ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        low = self.lower
        self.words = [low[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        self.info = self.lexicon.rows(self.words)
        upper, count = np.concatenate([[0], np.cumsum(self.flags & UPPER != 0)]), np.concatenate([[0], np.cumsum(self.flags & LETTER != 0)])
        up, n = upper[self.ends] - upper[self.starts], count[self.ends] - count[self.starts]
        first = self.flags[self.starts]
        #: 0 small letters, 1 capitalised, 2 all capitals, 3 a script without case, 4 other.
        self.case = np.select([first & CASELESS != 0, (up == n) & (n > 1), first & UPPER != 0, up == 0], [3, 2, 1, 0], 4)
        before, after = self.points[self.starts - 1], self.points[self.ends]
        glue = lambda c: (self.flags_of(c) & DIGIT != 0) | np.isin(c, [0x5F, 0x40, 0x23, 0x2B, 0xB0, 0x27, 0x2019])
        #: Whether a word hangs on a digit or on a sign that no name has beside it.
        self.glued = glue(before) | glue(after) & (after != 0x27) & (after != 0x2019) | ((before == 0x2D) & (self.flags[np.maximum(self.starts - 2, 0)] & (LETTER | DIGIT) != 0)) | ((before == 0x2E) & (self.flags[np.maximum(self.starts - 2, 0)] & LOWER != 0))

    @staticmethod
    def flags_of(points: np.ndarray) -> np.ndarray:
        return FLAGS[np.minimum(points, 0xFFFF)]

    def _find_breaks(self) -> None:
        p, flags = self.points, self.flags
        stop = np.isin(p, [0, 10, 13, 0x3002, 0xFF01, 0xFF1F, 0x21, 0x3F])
        dots = np.flatnonzero((p == 0x2E) & (np.roll(flags, -1) & SPACE != 0))
        if len(dots) and len(self.ends):
            i = np.searchsorted(self.ends, dots)
            i = np.minimum(i, len(self.ends) - 1)
            long = (self.ends[i] == dots) & (self.ends[i] - self.starts[i] >= 4)
            other = flags[dots - 1] & LETTER == 0
            stop[dots[long | other]] = True
        stop |= (p == 0x3C) & (np.roll(p, -1) == 0x62) & (np.roll(p, -2) == 0x72)  # <br
        stop |= (p == 32) & (np.roll(p, -1) == 32)
        #: Places where a sentence ends.
        self.breaks = np.flatnonzero(stop)

    def _find_east(self) -> None:
        """Stretches from the first to the last of the kana and kanji of each text that has some: patterns for these look there."""
        here = np.flatnonzero(self.flags & EAST != 0)
        which = self.texts_of(here)
        at = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1]) if len(here) else np.zeros(0, int)
        last = np.concatenate([at[1:], [len(here)]])[: len(at)] - 1
        self.east = list(zip((here[at] - 1).tolist(), np.minimum(here[last] + 30, len(self.points)).tolist(), strict=True))

    def in_east(self, pattern, overlapped: bool = False):
        """Matches of a pattern in those stretches."""
        for a, b in self.east:
            yield from pattern.finditer(self.text, a, b, overlapped=overlapped)

    def _find_cues(self) -> None:
        bits = self.info[:, Lexicon.CUE].astype(np.int64)
        self.cues = []
        for i, kind in enumerate(KINDS_OF_CUES):
            here = np.flatnonzero(bits >> i & 1)
            a, b = self.starts[here], self.ends[here]
            if self.east and kind in _EAST_CUES:
                found = [m.span() for m in self.in_east(_EAST_CUES[kind])]
                if found:
                    more = np.array(found, np.int64)
                    a, b = np.concatenate([a, more[:, 0]]), np.concatenate([b, more[:, 1]])
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], b[order]
            self.cues.append((a, b))

    def sentence(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The breaks around spans."""
        left = self.breaks[np.searchsorted(self.breaks, start) - 1]
        right = self.breaks[np.minimum(np.searchsorted(self.breaks, end), len(self.breaks) - 1)]
        return left, right

    @staticmethod
    def distances(spans: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the nearest of the spans before and after lies, within the sentence and within reach."""
        a, b = spans
        if not len(a):
            return np.full(len(start), FAR), np.full(len(start), FAR)
        i = np.searchsorted(b, start, side="right") - 1
        j = np.maximum(i, 0)
        before = np.where((i >= 0) & (a[j] > left) & (start - b[j] <= LEFT), start - b[j], FAR)
        i = np.searchsorted(a, end)
        j = np.minimum(i, len(a) - 1)
        after = np.where((i < len(a)) & (a[j] < right) & (a[j] - end <= RIGHT), a[j] - end, FAR)
        return before.astype(float), after.astype(float)

    def context(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each span: distances to the cues of each kind on both sides, to the ends of the sentence, what stands directly
        beside it, and how much of the surroundings is in capitals."""
        left, right = self.sentence(start, end)
        out = []
        for spans in self.cues:
            out += self.distances(spans, start, end, left, right)
        last = len(self.points) - 1
        out += [np.minimum(start - left, LEFT), np.minimum(right - end, RIGHT)]
        before, after = self.points[start - 1], self.points[end]
        second = np.where(before == 0, 0, self.points[np.maximum(start - 2, 0)]), np.where(after == 0, 0, self.points[np.minimum(end + 1, last)])
        out += [self._sign(c) for c in (before, after, *second)]
        a, b = np.maximum(start - 40, left + 1), np.minimum(end + 40, np.maximum(right, end))
        up = self.uppers[b] - self.uppers[a] - (self.uppers[end] - self.uppers[start])
        n = self.letters[b] - self.letters[a] - (self.letters[end] - self.letters[start])
        out.append(up / np.maximum(1, n))
        return np.column_stack(out).astype(np.float32) if len(start) else np.zeros((0, len(out)), np.float32)

    def _sign(self, c: np.ndarray) -> np.ndarray:
        """Kind of a character beside a span."""
        flags = self.flags_of(c)
        kind = np.select([c == 0, flags & EAST != 0, flags & SPACE != 0, np.isin(c, [0x2C, 0x3B]), c == 0x3A, np.isin(c, [0x28, 0x29, 0x3C, 0x3E, 0x5B, 0x5D]), c == 0x2E, c == 0x2F, flags & DIGIT != 0, flags & LETTER != 0], [0, 1, 2, 3, 4, 5, 6, 7, 9, 10], 8)
        return kind.astype(float)

    def texts_of(self, positions: np.ndarray) -> np.ndarray:
        """Number of the text that each position lies in."""
        return np.searchsorted(self.begins, positions, side="right") - 1
