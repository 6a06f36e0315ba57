"""Labelled texts for the PII models: sentences put together from parts, whose mentions are known exactly.

The wording is that of letters, calls and complaints in general, the names are common public ones, made of usual elements of
names, or invented sound by sound; no sentence, name, street, town or host is taken from the data. Plain sentences are drawn from
the words of a public vocabulary. The texts are as many as wanted and alike at every size of data.
"""

from __future__ import annotations

import random

from stratalog.llm.pii_text import CUES, FAMILY, GIVEN

#: Elements of which English and Germanic family names are made.
_HEADS = "Black White Wood Green Hart Brad Stan Craw Hux Whit Nor Bur Lang Thorn Mar Win Ash Har Wel Ald Ros Lin Hol Wes Nord Stein Eich Gold Silber Berg Rosen Linden Königs Hei Wald".split()
_TAILS = "ford ham ley ton by thorpe dale field worth stone bridge well gate hurst wood land brook burn more low shaw well mann bach feld hoff stein thal wald berg son sen lund strand qvist holm".split()
#: Sounds of names that are like no usual one.
_ONSETS = "b br c ch d dr f fr g gr h j k kl l m n p pr qu r s sch sh st t th tr v w y z zh ś ž".split()
_VOWELS = "a a e e i o u ai ea ie ou ü é ö".split()
_CODAS = ["", "", "", "l", "n", "r", "s", "t", "k", "m", "ng", "rd", "tt", "x", "ski", "rre", "nd", "st"]
_PARTICLES = ["von", "van", "de la", "van der", "de", "zu", "von der", "del", "di", "dos", "ter", "le"]
_KANJI_FAMILY = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 松本 井上 木村 斎藤 清水 山崎 森 橋本 石川 前田 藤田 後藤 岡田 長谷川 村上 近藤 石井 坂本 遠藤 青木 藤井 西村 福田 太田 三浦 岡本 松田".split()
_KANJI_GIVEN = "太郎 花子 健一 美咲 大輔 愛 翔太 陽子 直樹 由美 拓也 恵子 達也 真由美 和也 智子 誠 裕子 学 明美 健太 久美子 浩二 さくら 隆 麻衣 亮 彩 修 結衣 みゆき ひろし ゆうこ あかね 一郎 正 清 久美 春香 悠斗".split()
_KATAKANA = "マリア ジョン アンナ デイビッド エマ リカルド ソフィア グレン カルロス ミシェル スミス ガルシア ミュラー ロペス ブラウン デュボワ シュミット アンデルセン".split()
_STREETS = "Station Church Victoria Park Mill High Queen's King Bridge Garden Albert Chapel Manor Spring Elm Cedar Washington Lincoln Oak Maple Goethe Schiller Bahnhof Haupt Garten Linden Berg Wald Mozart Rosen Sommer Kirch Gambetta Voltaire Pasteur Lilas Moulin Mayor Alcalá Goya Sol Colón Cervantes Roma Garibaldi Verdi".split()
_TOWNS = "Leeds Bristol Austin Portland Dayton Toledo Bremen Kassel Mainz Lübeck Lyon Nantes Dijon Reims Sevilla Bilbao Murcia Cádiz Torino".split()
_HOSTS = "gmail outlook yahoo mail web posteo fastmail kpost orange telefonica netmail acme-corp uni-nord oficina boite".split()
_ENDS = "com net org de fr es co.uk io eu info jp".split()
#: Pairs of words that are written like names and are none.
_PAIRS = (
    "New York|Los Angeles|San Francisco|United Kingdom|South Africa|Lake District|Christmas Eve|New Year|Black Friday|Cyber Monday|Customer Service|Customer Support|Best Buy|Top Quality|Money Back|Five Stars|Good Value|Highly Recommended|User Guide|Quick Start|Living Room|Prime Day|"
    "Sehr Gut|Gute Qualität|Schnelle Lieferung|Preis Leistung|Schwarzer Freitag|Neues Jahr|Guten Tag|Liebes Team|Bad Homburg|Tolles Produkt|Großes Lob|Heiliger Abend|Stiftung Warentest|Bonne Qualité|Livraison Rapide|Bon Produit|Nouvel An|Service Client|Très Bien|Côte d'Azur|"
    "Muy Bueno|Buena Calidad|Envío Rápido|Nochebuena Pasada|Servicio Técnico|Costa Rica|Buenos Aires|San Sebastián|Año Nuevo|Real Madrid|Wi Fi|Blue Tooth|Power Bank|Pro Max|Mini Plus|Series Two|Type C|Extra Large|Dark Green|Light Grey|Navy Blue"
).split("|")
#: Nouns that German writes in capitals, and some of other languages.
_NOUNS = (
    "Qualität Preis Lieferung Verpackung Farbe Größe Material Verarbeitung Griff Deckel Kabel Stecker Akku Gerät Anleitung Schraube Boden Rand Form Gewicht Geruch Geschenk Garantie Rückgabe Ware Küche Bad Garten Keller Auto Fahrrad Reise Urlaub Arbeit Büro Schule Woche Monat Jahr Tag Abend Morgen Sommer Winter Frühling Herbst Problem Ergebnis Fazit Hinweis Vorteil Nachteil "
    "Freude Ärger Wasser Strom Licht Motor Filter Leder Holz Stoff Kunststoff Metall Glas Papier Quality Price Delivery Colour Size Battery Handle Box Manual Summer Winter Holiday Kitchen Garden Office Noël Été Maison Cuisine Bureau Navidad Verano Casa Cocina Oficina"
).split()

_MAKERS = "Tools House Home Works Tech Sport Line Design Living Outdoor Audio Kids Foods Garden Kitchen Store Electronics Direct Shop Group".split()
_ADJECTIVES = "Klare Gute Schöne Tolle Kleine Große Neue Beste Volle Absolute Schnelle Einfache Echte Reine Super Schlechte Lange Kurze Viele Keine Diese Meine Unsere Erste Zweite Letzte Nette Feine Dicke Dünne Harte Weiche".split()

#: What stands before and after a mention of each kind, by language. {b} a brand, {d} a date, {m} a price, {g} a given name.
AROUND = {
    "name": {
        "en": (
            ["I dealt with ", "The engineer, ", "Our plumber ", "We were served by ", "Thanks to ", "Special thanks to ", "A big thank you to ", "I have been in touch with ", "You can verify this with ", "Please forward this to ", "The account is registered to ", "Name: ", "Attn. ", "c/o ", "Mr ", "Mrs ", "Ms. ", "Dr. ",
             "Best wishes,\n", "Best wishes, ", "Yours sincerely, ", "Kind regards\n", "Kind regards, ", "Cheers, ", "Sincerely,\n", "Signed: ", "Yours,\n", "-- ", "- ", "~ ", "Registered under ", "Everything is in the name of ", "The contract runs under ", "{d}, ", "Greetings from ", "Written by ", "Reviewed by ", "my husband ", "My neighbour ", "My colleague ", "Her name is ", "I'm ", "My name is ", "This is ", "The parcel was signed for by ", "Invoice recipient: ", "", "", "", "Yesterday ", "According to ", "I bought it from ", "We met ", "I know ", "I saw ", "It was ", "Someone called ", "I told ", "please tell ", "and ", "The driver (", "Even ", "Nobody but ", "Ask for "],
            [" was extremely helpful.", " never called back.", " sorted it out within a day.", ", who lives next door, agrees.", " on the help desk.", " from your support team.", " knows about it.", ".", ".", "", "", " (owner)", " told me to wait.", " installed it for us.", " and the rest of the crew.", " has one as well.", ", a real professional.", ", born {d}.", ", born {d}, ", " has the keys.", " put it together.", " came to repair it.", "!", " recommended this one.", " at the counter.", " opened the box.", " and {p}.", " {v} it {v}.", ", 42 years old, from {t}", " will confirm."],
        ),
        "de": (
            ["Frau ", "Herr ", "Herrn ", "Mit freundlichen Grüßen\n", "Freundliche Grüße, ", "Beste Grüße ", "Herzliche Grüße, ", "Schöne Grüße,\n", "Gezeichnet ", "i. A. ", "LG ", "Ihr ", "Ansprechpartner: ", "- ", "Auf den Namen ", "Alles läuft auf ", "Der Techniker ", "Unser Nachbar ", "Meine Kollegin ", "Mein Name ist ", "Ich heiße ", "Besonderer Dank geht an ", "Am Telefon war ", "Geschrieben von ", "Empfänger: ", "Name: ", "", "", "Der Verkäufer, ", "Wir wurden von ", "Ich hatte Kontakt mit ", "Ich kenne ", "Wir trafen ", "Dann kam ", "Es war ", "und ", "Gestern hat ", "z. Hd. "],
            [" war sehr hilfsbereit.", " hat sich nie gemeldet.", " hat alles erklärt.", ", der nebenan wohnt, sieht das genauso.", " im Laden.", ".", "", "", " hat es montiert.", " gut beraten.", " und Familie.", "!", " wollte zurückrufen.", " am Empfang.", " und {p}.", " {v} {v}.", " aus {t}."],
        ),
        "fr": (
            ["Monsieur ", "Madame ", "M. ", "Mme ", "Bien à vous,\n", "Sincères salutations, ", "Bien cordialement\n", "Bien cordialement, ", "Amicalement, ", "Signature : ", "- ", "Au nom de ", "Signé : ", "Notre voisin ", "Ma collègue ", "Je m'appelle ", "Mon nom est ", "Un grand merci à ", "Le technicien, ", "J'ai eu affaire à ", "Au téléphone, ", "Nom : ", "Destinataire : ", "", "", "Avis rédigé par ", "Le vendeur, ", "Je connais ", "Nous avons vu ", "C'était ", "et ", "Hier, ", "Contactez "],
            [" a été très serviable.", " n'a jamais répondu.", " nous a tout expliqué.", ", qui habite à côté, confirme.", " du service après-vente.", ".", "", "", " l'a installé.", " et toute son équipe.", " !", " devait me recontacter.", " à l'entrée.", " et {p}.", " {v} {v}.", " de {t}."],
        ),
        "es": (
            ["Señor ", "Señora ", "Sr. ", "Sra. ", "Don ", "Atentamente,\n", "Un cordial saludo,\n", "Un cordial saludo, ", "Saludos, ", "Cordialmente, ", "Saludos de ", "- ", "A nombre de ", "Firma: ", "Mi vecino ", "Mi compañera ", "Me llamo ", "Mi nombre es ", "Muchas gracias a ", "El técnico, ", "Nos atendió ", "Nombre: ", "Destinatario: ", "", "", "Escrito por ", "El vendedor, ", "Conozco a ", "Vimos a ", "Fue ", "y ", "Ayer ", "Contacté con "],
            [" fue de gran ayuda.", " nunca contestó.", " nos lo explicó todo.", ", que vive al lado, lo confirma.", " del servicio técnico.", ".", "", "", " lo instaló.", " y todo su equipo.", "!", " quedó en llamarme.", " en la entrada.", " y {p}.", " {v} {v}.", " de {t}."],
        ),
        "ja": (["担当の", "氏名:", "お名前 ", "宛名:", "隣人の", "昨日、", "店員の", "", "", "私は", "名前は", "友人の", "受取人:"], ["さんに助けられました。", "様", "さんの対応が良かったです。", "です。", "さんから返事がありません。", "", "も持っています。", "と申します。", "さん、ありがとうございました。", "氏が説明してくれた。"]),
    },
    "phone": {
        "en": (["My number is ", "Phone: ", "Mobile ", "You may reach me under ", "Tel ", "Whatsapp ", "Text ", "Give me a ring at ", "Landline: ", "", "Dial ", "Fax ", "I can be reached at ", "The hotline is ", "({p}, ", "Contact number "], [" in the evening.", ".", " any day.", "", ", thanks.", ")", " if it turns up.", " - ask for me."]),
        "de": (["Meine Nummer: ", "Telefon ", "Handy: ", "Tel.: ", "Bitte melden unter ", "Mobil ", "Sie können mich unter ", "Fax ", "", "Rufnummer "], [" erreichen.", ".", "", " ab 17 Uhr.", ", danke."]),
        "fr": (["Mon numéro : ", "Tél. ", "Portable ", "Joignable au ", "Mobile : ", "Téléphonez-moi au ", "", "Fax "], [" le soir.", ".", "", ", merci.", " svp"]),
        "es": (["Mi número es el ", "Tel. ", "Móvil: ", "Llámenme al ", "Pueden localizarme en el ", "", "Fax ", "Teléfono "], [" por la tarde.", ".", "", ", gracias."]),
        "ja": (["電話番号:", "携帯は", "連絡先:", "", "お電話は"], ["です。", "", "までお願いします。", "。"]),
    },
    "id_number": {
        "en": (["Passport number ", "My SSN is ", "National insurance: ", "Social security ", "They photographed my ID card, ", "Driving licence ", "Tax ID ", "Why do you need my passport no. ", "Proof of identity: ", "Identity card ", "My details: {p}, ", "My personal number, ", "The clerk wanted my social security number, and I told him: ", "For the tax number I put ", "A passport number was needed, I gave ", "Anyone can read ", "Born {d}, ", "The number ", "My file shows ", "They wrote ", "", "It reads "], [".", " was asked for.", " is visible on the form.", " on the envelope for everyone.", " and I want it removed.", "", ", really?", " is on file.", " through the envelope window.", ", printed in full."]),
        "de": (["Personalausweis ", "Reisepass Nr. ", "Steuernummer ", "Steueridentifikationsnummer: ", "Sozialversicherungsnummer ", "Führerschein ", "Mein Ausweis, ", "Ausweis-Nr. ", "Man wollte meine Steuernummer wissen, also: ", "Für den Ausweis musste ich angeben: ", "Jeder konnte meine Nummer ", "Geboren am {d}, ", "Die Nummer ", "Auf dem Umschlag steht ", ""], [".", " stand auf dem Formular.", ", für alle sichtbar.", " wurde verlangt.", "", ", wozu?", " lesen."]),
        "fr": (["Carte d'identité ", "Passeport n° ", "Numéro de sécu ", "Sécurité sociale : ", "Permis de conduire ", "Numéro fiscal ", "Ma pièce d'identité, ", "On voulait mon numéro de sécurité sociale, alors voilà : ", "Tout le monde pouvait lire ", "Né le {d}, ", "Le numéro ", "Sur l'enveloppe figure ", ""], [".", " figurait sur le formulaire.", ", visible par tous.", " a été exigé.", "", ", pour quoi faire ?"]),
        "es": (["Pasaporte ", "DNI ", "NIE: ", "NIF ", "Seguridad social ", "Carné de conducir ", "Mi documento, ", "Número fiscal ", "Querían mi número de la seguridad social, aquí está: ", "Cualquiera podía leer ", "Nacido el {d}, ", "El número ", "En el sobre pone ", ""], [".", " figuraba en el formulario.", ", visible para todos.", " lo exigieron.", "", ", ¿para qué?"]),
        "ja": (["旅券番号:", "マイナンバーは", "免許証番号", "保険証の番号は", "身分証番号:"], ["です。", "。", "", "を聞かれました。"]),
    },
    "address": {
        "en": (["I live at ", "My address: ", "We moved to ", "Ship to ", "It should have gone to ", "Collect it from ", "{p}, ", "The shop at ", "Home address ", "Please use ", "They brought it round to ", "", "Return it to ", "Based at "], [".", ", second floor.", " as of this week.", "", ", not next door.", " instead of my old flat.", ", thank you."]),
        "de": (["Ich wohne in der ", "Unsere Adresse ist nun ", "Als Anschrift gilt ", "Die Adresse heißt ", "Richtig ist ", "Adresse: ", "Wir sind umgezogen: ", "Lieferanschrift: ", "Abzuholen bei ", "{p}, ", "Der Laden in der ", "", "Zustellung an ", "Richtig wäre "], [".", ", zweiter Stock.", "", ", nicht nebenan.", ", vielen Dank."]),
        "fr": (["J'habite au ", "Adresse : ", "Nous avons déménagé au ", "Livrez au ", "À récupérer au ", "{p}, ", "La boutique du ", "", "Domicile : "], [".", ", deuxième étage.", "", ", pas à côté.", ", merci."]),
        "es": (["Vivo en ", "Dirección: ", "Nos mudamos a ", "Entregar en ", "Recoger en ", "{p}, ", "La tienda de ", "", "Domicilio: "], [".", ", segundo piso.", "", ", no al lado.", ", gracias."]),
        "ja": (["住所は", "届け先:", "送り先は", "", "配送先 "], ["です。", "", "に住んでいます。", "までお願いします。", "。"]),
    },
    "email": {
        "en": (["Mail ", "Email: ", "My address is ", "Send photos to ", "", "{p} <", "Reply to ", "cc "], [".", "", " please.", ">", " and not by post."]),
        "de": (["E-Mail: ", "Schreiben Sie mir: ", "Mail an ", "", "Antwort bitte an "], [".", "", " bitte.", ", danke."]),
        "fr": (["E-mail : ", "Courriel ", "Répondez à ", ""], [".", "", " svp.", ", merci."]),
        "es": (["Correo: ", "Respondan a ", "Email ", ""], [".", "", " por favor.", ", gracias."]),
        "ja": (["メール:", "アドレスは", ""], ["です。", "", "まで。", "。"]),
    },
}
#: Sentences without a mention that look like some. {o} a number of goods, {c} a bar code, {w} a name of a place or thing, {k} a noun, {x} a pair that is no name, {s} a street, {h} a host, {u} plain words, {v} one of them, {y} a number, {z} a word in no vocabulary, {q} an adjective.
PLAIN = {
    "en": ["Order no. {o}.", "Invoice {o} of {d}.", "My order number is {o}", "Spare part {o} is missing.", "Model {o} from {b}.", "Serial no {o}.", "Tracking {o} shows nothing.", "Thanks {b}: {z}, {z} and {z}.", "{z}, {z}.", "{z}, but {u}.", "{u} {z}, {z}.", "It takes {y} V. {u}.", "Up to {y} °C. {u}.", "Size M. {u}.", "Type C. {v} {v}.", "The {b} {v} is {v}.", "by {b}, {u}.", "{b} is {v}.", "{b} have {v} it.", "from {b}: {v}, {v} and {v}.", "{v}, {v}, {v}.", "{v}, but {u}.", "Mine is from {b}. {u}.", "{u} {b} {v}. {u}.", "for {b}. {u}", "{k} {m}, {k} {d}, {u}.", "A {b} {v} for {m}.", "EAN {c}", "SKU {o}", "Ref. {o}.", "Product code {o} by {b}.", "{g} likes it.", "{g} is four and plays with it.", "Bought for my son {g}.", "Our dog {g} chewed it.", "Dear {b}, this is poor.",
           "{b} {k} are better.", "Another {b} {k} for me.", "The {x} came with it.", "{x}!", "{x}: {u}.", "We drove to {w} with it.", "{w} is where it was made.", "The shop on {s} Road has it.", "Off {s} Street.", "See {h}.com/help.", "www.{h}.org", "@{v}_{v} showed it.", "Paid {m}.", "It was {m}, {y} pieces.", "{y} x {y} x {y} cm.", "It ran for {y} hours.", "Around {y} km so far.", "Rated {y} W.", "{k}, {k} and {k} are fine.", "{k} {k}.", "{u}, {u}.", "{u}.", "{u}!", "{u}. {u}.", "I {u}.", "My {v} and I {u}.", "Thanks, {u}.", "Thank you {b}.", "Thanks for the {v} {v}.", "from the {v} of the {v}", "{w} {k} is nice", "In {w}, {w} and {w} they have it.", "We met in {w}.", "You could ask the {v} {v}."],
    "de": ["Bestellung Nr. {o}.", "Rechnung {o} vom {d}.", "Artikelnr. {o}.", "Seriennr.: {o}", "Modell {o} von {b}.", "Ersatzteil {o} fehlt.", "Sendung {o} ist weg.", "{q} {k}", "Im {k} {y} {u}.", "zur {k} {y}", "am {k} {y}, {u}.", "{q} {k}, {q} {k}.", "{q} {k}: {u}.", "Danke {b}: {z}, {z} und {z}.", "{z}, {z}, {u}.", "In {y} {k} {v}, {u}.", "In {y} {k} {z}, {u}.", "Mit {y} V. {u}.", "Bis {y} °C. {u}.", "Größe M. {u}.", "{k} in {y} {k}, {k} {m}, {u}.", "Nach {y} {k}, {k} inklusive.", "Das {k} von {b} ist {v}.", "{b}: {v}, {v} und {v}.", "{v}, {v}, {v}.", "Für {b}. {u}.", "{b} hat {v}.", "EAN {c}", "{g} mag es.", "Für meine Tochter {g}.", "Unser Hund {g} hat es zerbissen.", "Liebes {b}-Team, schade.", "Die {k} von {b} ist besser.", "{k} und {k} stimmen.", "{k}, {k}, {k}: alles gut.", "{k} {k}.", "Gute {k}, schlechte {k}.", "Für {k} und {k}, {k} inklusive.",
           "{x}!", "{x}: {u}.", "Wir waren damit in {w}.", "Der Laden in der {s}straße hat es.", "Siehe {h}.de/hilfe", "Gekauft am {d}, {m}.", "{y} cm breit.", "Seit {y} Wochen.", "{y} mal benutzt.", "{u}.", "{u}, {u}.", "Von {w} nach {w}.", "Danke {b}.", "Vielen Dank für die {k}.", "Mit der {k} bin ich zufrieden."],
    "fr": ["Commande n° {o}.", "Facture {o} du {d}.", "Réf. {o}", "Modèle {o} de {b}.", "Numéro de suivi {o}.", "Merci {b} : {z}, {z} et {z}.", "{z}, {z}, {u}.", "Avec {y} V. {u}.", "Jusqu'à {y} °C. {u}.", "Taille M. {u}.", "{b} : {v}, {v} et {v}.", "{v}, {v}, {v}.", "Le {v} de {b} est {v}.", "{k}, {k} {m}, {u}.", "sans {v} le {v}", "Code EAN {c}", "{g} aime bien.", "Pour ma fille {g}.", "Notre chien {g} l'a mordu.", "Chère équipe {b}, dommage.", "{k} et {k}.", "{x} !", "{x} : {u}.", "Nous étions à {w}.", "La boutique de la rue {s} l'a.", "Voir {h}.fr/aide", "Acheté le {d} pour {m}.", "{y} cm de large.", "Depuis {y} semaines.", "{u}.", "{u}, {u}.", "De {w} à {w}.", "Merci {b}.", "Merci pour la {v}."],
    "es": ["Pedido n.º {o}.", "Factura {o} del {d}.", "Ref. {o}", "Modelo {o} de {b}.", "Seguimiento {o}.", "Gracias {b}: {z}, {z} y {z}.", "{z}, {z}, {u}.", "{z} y {z}", "Con {y} V. {u}.", "Hasta {y} °C. {u}.", "Talla M. {u}.", "{b}: {v}, {v} y {v}.", "{v}, {v}, {v}.", "El {v} de {b} es {v} y {v}.", "{k}, {k} {m}, {u}.", "en la {v} de {v}", "Código EAN {c}", "A {g} le gusta.", "Para mi hija {g}.", "Nuestro perro {g} lo mordió.", "Querido equipo de {b}, qué pena.", "{k} y {k}.", "¡{x}!", "{x}: {u}.", "Fuimos a {w}.", "La tienda de la calle {s} lo tiene.", "Ver {h}.es/ayuda", "Comprado el {d} por {m}.", "{y} cm de ancho.", "Desde hace {y} semanas.", "{u}.", "{u}, {u}.", "De {w} a {w}.", "Gracias {b}.", "Gracias por la {v}."],
    "ja": ["注文番号:{o}", "請求書番号は{o}です。", "型番は{o}。", "製造番号 {o}", "追跡番号{o}が動きません。", "JANコード {c}", "{b}の製品です。", "お客様", "配達業者さんが遅い。", "店員さんは親切。", "皆様にお勧めします。", "品質良好", "満足度 高い", "郵便局員さんへ。", "{m}で買いました。", "{y}日で届きました。", "{g}が気に入っています。", "大変満足", "担当者様へ。", "管理人さんに預けた。", "価格、品質、配送。", "総合評価 最高", "使用期間 三年", "{x}", "友人にも勧めたい。", "販売店様", "娘の誕生日に。"],
}
#: The same in any language; {e} a word that tells of a person, {n} a word that is only known with a capital.
_ANYWHERE = [
    "{e} {u}.", "{e} {k} {z}", "{e}, {u}.", "{u} {e} {x}.", "{e} {b}.", "{e} {b}, {u}", "{e} {w}, {k}.", "{e} {n}: {u}.", "{n}, {n}, {n}.", "{u} {n}.", "{u} {n} {v} {u}.", "{n} {v} {n}", "{k}, {n}.", "{e} {x}!", "{u}, {n} {v}.", "{e} {q} {k}", "{u} {e}. {u}", "{y} {n} {z}, {u}", "{n}: {u}",
]
_WEIGHTS = {"en": 50, "de": 15, "fr": 13, "es": 13, "ja": 9}


class Writer:
    """Draws mentions and puts labelled texts together. ``words`` are words of the languages in small letters, most usual ones
    first; ``capitals`` are words that are only known with a capital: names of people and places, and German nouns."""

    def __init__(self, seed: int, given: list[str], brands: list[str], words: list[str] = (), capitals: list[str] = ()):
        self.capitals = list(capitals) or _TOWNS
        self.r, self.given, self.brands = random.Random(seed), sorted(g for g in given if g), sorted(b for b in brands if b)
        self.words = list(words) or "the of and to in good bad very nice with it is not for".split()
        #: Words that stand before a mention of each kind.
        self.cued = {
            "name": [w for k in ("closing", "title", "relation", "speech", "service", "place") for w in CUES[k].split()], "phone": CUES["phone"].split(), "id_number": CUES["id"].split(), "address": CUES["place"].split(), "email": CUES["mail"].split(),
        }

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def shaped(self, shape: str) -> str:
        """d becomes a digit, D one that is not 0, A a letter; the rest stays."""
        return "".join(self.r.choice("0123456789") if c == "d" else self.r.choice("123456789") if c == "D" else self.r.choice("ABCDEFGHJKLMNPRSTXYZ") if c == "A" else c for c in shape)

    def phone(self, lang: str) -> str:
        r = self.r
        shapes = {
            "en": ["(Ddd) ddd-dddd", "Ddd-ddd-dddd", "Ddd.ddd.dddd", "Ddddddddddd"[:10], "Ddd ddd dddd", "+1 Ddd ddd dddd", "1-Ddd-ddd-dddd", "+1-Ddd-ddd-dddd", "01ddd dddddd", "(01ddd) dddddd", "(01ddd) ddd ddd", "01ddd-ddd-ddd", "020 dddd dddd", "07ddd dddddd", "07dddddddd"[:10] + "d", "+44 1ddd ddd ddd", "+44(0)1ddddddddd", "0044 1ddd dddddd", "ddd-dddd", "+91 Dddd dddddd", "01ddd ddd ddd"],
            "de": ["0Dd/ddddddd", "(0Dd) ddddd-ddd", "0Dd ddddd ddd", "+49 Dd ddddd ddd", "0049 Dd dddddddd", "017d ddddddd", "0151-dddddddd", "0Ddd dddddd", "+49 15d dddddddd", "0Dddd/dddddd", "0Dd-dddddd"],
            "fr": ["0D dd dd dd dd", "0Ddddddddd", "0D.dd.dd.dd.dd", "+33(0)Ddd dd dddd", "+33 D dd dd dd dd", "0D-dd-dd-dd-dd", "0Ddd dddddd", "0033 D dd dd dd dd"],
            "es": ["+34 Ddd ddd ddd", "9dd ddd ddd", "6dd dd dd dd", "(9dd) ddd-ddd", "Ddddddddd", "6dd ddd ddd", "+34Ddddddddd", "9d ddd dd dd"],
            "ja": ["0D-dddd-dddd", "090-dddd-dddd", "080dddddddd", "0dd-ddd-dddd", "+81 90-dddd-dddd", "0ddd-dd-dddd"],
        }
        kind = lang if r.random() < 0.7 else r.choice(list(shapes))
        s = self.shaped(r.choice(shapes[kind]))
        if lang == "ja" and r.random() < 0.3:
            s = s.translate({ord("0") + i: 0xFF10 + i for i in range(10)})
        elif r.random() < 0.03:
            names = {"de": "null eins zwei drei vier fünf sechs sieben acht neun", "fr": "zéro un deux trois quatre cinq six sept huit neuf", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve"}.get(lang, "oh one two three four five six seven eight nine").split()
            s = r.choice([" ", ", "] if lang == "en" else [" "]).join(names[int(c)] for c in s if c.isdigit())
        elif r.random() < 0.06:
            s += r.choice([" ext. ", " ext ", " x"]) + self.digits(r.choice([2, 3, 4]))
        return s

    def id_number(self, lang: str) -> str:
        r = self.r
        shapes = {
            "en": ["ddd-dd-dddd", "ddd dd dddd", "ddddddddd", "Adddddddd", "AA dd dd dd A", "AAddddddA", "AA dddddd A", "AAddddddd", "AA ddddddd", "ddddddddd"],
            "de": ["dd ddd ddd ddd", "ddddddddddd", "AdAAddddd d", "AdAAddddd", "AdddddddAd", "dd dddddd A ddd", "AddAAddAd", "AdA Adddd d", "Add Adddd d"],
            "fr": ["D dd dd dd ddd ddd dd", "Ddddddddddddddd", "D-dd-dd-dd-ddd-ddd", "ddAAddddd", "Ddddddddddddd", "dd dd ddd ddd ddd"],
            "es": ["dddddddd A", "ddddddddA", "dd.ddd.ddd-A", "X-ddddddd-A", "YdddddddA", "AAAdddddd", "dddddddd-A"],
            "ja": ["dddd dddd dddd", "AAddddddd", "dddddddddddd", "AA ddddddd"],
        }
        s = self.shaped(r.choice(shapes[lang if r.random() < 0.75 else r.choice(list(shapes))]))
        return s.lower() if r.random() < 0.06 else s

    def order(self) -> str:
        r = self.r
        if r.random() < 0.25:
            return self.id_number(r.choice(list(_WEIGHTS))).upper()
        if r.random() < 0.15:
            return self.phone("en").split(" ext")[0]
        return self.shaped(r.choice(["Adddddddd", "AAAdddddddd", "ddd ddd dddd", "#ddddddddd", "ddd-ddddddd-ddddddd", "AAddddddA", "AAdddddddddd", "dddd dddd dd", "AdddddddA", "dddd-ddd", "dddd/dd", "AA-ddddd", "ddddddddd", "dddddddddd", "AA-dddd-dd", "ddddd", "#dddddd", "Ddddd-AA", "AdddA", "dd-ddddd-ddd"]))

    def invented(self) -> str:
        """A word like none of the usual names."""
        r = self.r
        while True:
            s = "".join(r.choice(_ONSETS) + r.choice(_VOWELS) + r.choice(_CODAS) for _ in range(r.choice([1, 2, 2, 2, 3])))
            if len(s) > 1:
                return s.capitalize()

    def family(self, lang: str) -> str:
        r = self.r
        lang = lang if lang in FAMILY and r.random() < 0.7 else r.choice(list(FAMILY))
        x = r.random()
        s = r.choice(FAMILY[lang]) if x < 0.42 else r.choice(self.capitals) if x < 0.52 else r.choice(_HEADS) + r.choice(_TAILS) if x < 0.75 else self.invented()
        x = r.random()
        if x < 0.03:
            s = r.choice(["O'", "Mc", "Mac", "D'", "Fitz", "Ó "]).strip() + s
        elif x < 0.08:
            s = f"{s}-{r.choice(FAMILY[lang]) if r.random() < 0.5 else self.invented()}"
        return f"{r.choice(_PARTICLES)} {s}" if r.random() < 0.08 else s

    def one_given(self, lang: str = "en") -> str:
        r = self.r
        x = r.random()
        if x < 0.04:
            return r.choice(self.capitals)
        if x < 0.42 or not self.given:
            return r.choice(GIVEN[lang if lang in GIVEN and r.random() < 0.7 else r.choice(list(GIVEN))])
        if x < 0.63:
            return r.choice(self.given)
        if x < 0.81:  # names as the listed ones, but not listed
            a, b = r.choice(self.given), r.choice(self.given)
            return a[:3] + b[3:]
        return self.invented()

    def name(self, lang: str, plain: bool = False) -> str:
        r = self.r
        if lang == "ja" and r.random() < 0.55:
            if r.random() < 0.12:
                return r.choice(_KATAKANA[:10]) + "・" + r.choice(_KATAKANA[10:])
            return r.choice(_KANJI_FAMILY) + r.choice(["", "", " ", "　"]) + r.choice(_KANJI_GIVEN)
        g, f = self.one_given(lang), self.family(lang)
        if r.random() < 0.07:
            g = f"{g}-{self.one_given(lang)}"
        x, letter = r.random(), lambda: r.choice("ABCDEFGHJKLMNPRSTUVWZ")
        if plain or x < 0.56:
            s = f"{g} {f}"
        elif x < 0.64:
            s = f"{g} {letter()}. {f}"
        elif x < 0.69:
            s = f"{g} {f} {self.family(lang).split(' ')[-1]}" if lang == "es" or r.random() < 0.3 else f"{g} {f}"
        elif x < 0.81:
            s = f"{f}, {g}"
        elif x < 0.94:
            s = f"{g[0]}. {f}" if r.random() < 0.85 else f"{g[0]}. {letter()}. {f}" if r.random() < 0.6 else f"{g[0]}.{f}"
        else:
            s = f"{f}, {g[0]}."
        return s

    def address(self, lang: str) -> str:
        r = self.r
        n, s, town = str(r.randrange(1, 300) if r.random() < 0.85 else r.randrange(1000, 20_000)), r.choice(_STREETS) if r.random() < 0.55 else self.family("en").split(" ")[-1], r.choice(_TOWNS) if r.random() < 0.6 else self.invented()
        if lang == "ja" and r.random() < 0.5:
            return r.choice(["東京都", "大阪府", "", "福岡県"]) + r.choice(["新宿区", "中央区", "緑区", "横浜市西区", "港区"]) + r.choice(["西町", "本町", "南", "桜台", "栄"]) + r.choice([f"{r.randrange(1, 9)}-{r.randrange(1, 30)}-{r.randrange(1, 20)}", f"{r.randrange(1, 9)}丁目{r.randrange(1, 30)}番{r.randrange(1, 20)}号"])
        kind = lang if lang in ("de", "fr", "es") and r.random() < 0.75 else r.choice(["en", "en", "en", "de", "fr", "es"])
        if kind == "en":
            n = r.choice([n, n, n, n + r.choice("abc"), f"{n}-{int(n) + 2}"])
            s = f"{s} {r.choice(_STREETS)}" if r.random() < 0.1 else s
            a = f"{n} {s} {r.choice(['Street', 'St.', 'St', 'Road', 'Rd', 'Lane', 'Row', 'Avenue', 'Ave', 'Drive', 'Close', 'Court', 'Way', 'Terrace', 'Square', 'Place', 'Boulevard', 'Crescent', 'Mews', 'Hill', 'Gardens', 'Parade', 'Grove', 'Walk', 'Green', 'Quay'])}"
            a = f"{r.choice(['Flat', 'Apt', 'Unit', 'Suite'])} {r.randrange(1, 40)}, {a}" if r.random() < 0.12 else a + (f" Apt {r.randrange(1, 40)}" if r.random() < 0.08 else "")
            a += r.choice(["", "", f", {town}", f", {town} {self.shaped('AAd dAA')}", f", {town}, {self.shaped('AA ddddd')}"])
        elif kind == "de":
            a = r.choice([f"{s}straße {n}", f"{s}weg {n}", f"{s}gasse {n}", f"{s}platz {n}", f"Am {s}platz {n}", f"{s}str. {n}", f"{s}er Straße {n}", f"{s}allee {n}", f"An der {s}straße {n}", f"Alte {s}straße {n}", f"{s}-{r.choice(_STREETS)}-Straße {n}", f"{s}strasse {n}"]) + r.choice(["", "", r.choice("abc")]) + r.choice(["", f", {self.digits(5)} {town}"])
        elif kind == "fr":
            a = r.choice([f"{n} avenue de {s}", f"{n}, rue {s}", f"{n} bis rue du {s}", f"{n} bd {s}", f"{n}, chemin des {s}s", f"{n} rue {s}", f"{n} place {s}", f"{n} boulevard {s}", f"{n} impasse des {s}", f"{n}, quai {s}"]) + r.choice(["", f", {self.digits(5)} {town}"])
        else:
            a = r.choice([f"Calle {s}, {n}", f"C/ {s}, {n}", f"Avda. de {s}, {n}", f"plaza {s} {n}", f"Paseo de {s}, {n}", f"Calle de {s} {n}", f"Avenida {s} {n}", f"C/ {s} {n}", f"Via {s} {n}", f"Viale {s} {n}", f"Piazza {s}, {n}", f"Calle del {s}, nº {n}"]) + r.choice(["", f", {self.digits(5)} {town}"])
        return a

    def email(self, lang: str) -> str:
        r = self.r
        g, f = self.one_given(lang).lower(), self.family(lang).lower().replace(" ", "")
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{f}-{g}", f"{f}{self.digits(2)}", f"{g}{self.digits(4)}", f"{g[0]}{f}", g, f"info.{f}"]) + r.choice(["", "", "", "+inbox"])
        host = f"{r.choice(_HOSTS)}.{r.choice(_ENDS)}" if r.random() < 0.7 else f"{self.invented().lower()}.{r.choice(_ENDS)}"
        x = r.random()
        if x < 0.78:
            return f"{local}@{host}"
        if x < 0.82:
            return f"{local}＠{host}"
        at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" {at} ", " . "), (" at ", " dot "), ("(AT)", "."), (" @ ", "."), (" [at] ", " [dot] ")])
        return local + at + host.replace(".", dot)

    def money(self) -> str:
        n = f"{self.r.randrange(5, 900)}.{self.digits(2)}"
        return self.r.choice([f"${n}", f"£{n}", f"{n} EUR", n, n.replace(".", ",") + " €", f"{self.r.randrange(500, 90000)}円"])

    def date(self) -> str:
        r = self.r
        d, m, y = r.randrange(1, 28), r.randrange(1, 13), r.randrange(1950, 2026)
        return r.choice([f"{d}.{m}.{y}", f"{y}-{m:02d}-{d:02d}", f"{m}/{d}/{y % 100:02d}", f"{d:02d}/{m:02d}/{y}"])

    def place(self) -> str:
        x = self.r.random()
        return self.r.choice(_TOWNS) if x < 0.35 else self.r.choice(self.capitals) if x < 0.65 else self.invented()

    def usual(self) -> str:
        """A word, the usual ones more often; some with a typing error or a longer ending, so that they are in no vocabulary."""
        r = self.r
        w, x = self.words[int(len(self.words) * r.random() ** 2)], r.random()
        if x < 0.08 and len(w) > 3:
            i = r.randrange(len(w) - 1)
            w = w[:i] + w[i + 1] + w[i] + w[i + 2 :] if x < 0.04 else w[:i] + w[i + 1 :]
        elif x < 0.22:
            w += r.choice("ness ly ing ed able less ful ism ical keit ung lich bar lose ment ement euse eux ique ción mente ado oso ico idad".split())
        return w

    def unusual(self) -> str:
        """A word in small letters that no vocabulary has as it is."""
        r = self.r
        a, b = r.choice(self.words), r.choice(self.words)
        return a + r.choice(["", "", b[-4:]]) + r.choice("ness ly able less ful ism ical keit lich bar los ment euse eux ique mente ado oso ico ido ante ent".split())

    def plain(self) -> str:
        """Some words in a row, the first, all, or some of them capitalised."""
        r = self.r
        words = [self.usual() if r.random() < 0.92 else self.unusual() for _ in range(r.randrange(2, 9))]
        if r.random() < 0.1:
            words[0] = self.unusual()
        x = r.random()
        if x < 0.6:
            words[0] = words[0].capitalize()
        elif x < 0.72:
            words = [w.capitalize() for w in words[:4]]
        elif x < 0.85:
            words = [w.capitalize() if r.random() < 0.35 else w for w in words]
        return " ".join(w + ("," if r.random() < 0.06 else "") for w in words).rstrip(",")

    def sentence(self, lang: str) -> list:
        """Parts of a sentence: strings, and (kind, string) for mentions."""
        r = self.r
        kinds = {"name": self.name, "phone": self.phone, "id_number": self.id_number, "address": self.address, "email": self.email}
        fill = {
            "o": self.order, "d": self.date, "b": lambda: r.choice(self.brands) if self.brands and r.random() < 0.6 else " ".join([self.invented(), r.choice(_MAKERS)][: r.randrange(1, 3)]), "c": lambda: self.digits(13), "g": lambda: self.one_given(lang), "s": lambda: r.choice(_STREETS), "h": lambda: r.choice(_HOSTS),
            "m": self.money, "w": self.place, "k": lambda: r.choice(_NOUNS), "x": lambda: r.choice(_PAIRS), "u": self.plain, "v": self.usual, "z": self.unusual, "q": lambda: r.choice(_ADJECTIVES), "y": lambda: str(r.randrange(1, 5000)), "t": self.place, "p": lambda: ("name", self.name(lang)), "e": lambda: r.choice(self.cued["name"]).capitalize(), "n": lambda: r.choice(self.capitals),
        }
        if r.random() < 0.05:  # ways to reach a person, side by side
            both = [r.choice(["phone", "email", "phone", "address"]), r.choice(["email", "phone"])]
            pre, mid, post = r.choice(["", "", "{p}: ", "({p}) ", "{p}, ", "{u}: ", "{u} "]), r.choice([" / ", ", ", " or ", " oder ", " ou ", " o ", "; ", " and ", " nor ", " bzw. ", "\n"]), r.choice(["", ".", " {u}."])
            parts = [*_filled(pre, fill), (both[0], kinds[both[0]](lang)), mid, (both[1], kinds[both[1]](lang)), *_filled(post, fill)]
        elif r.random() < 0.5:
            kind = r.choices(list(kinds), [40, 16, 15, 17, 8])[0]
            before, after = AROUND[kind][lang]
            pre, post = r.choice(before), r.choice(after)
            if lang != "ja" and kind in self.cued and r.random() < 0.3:  # any word that tells of such a mention, in any usual form
                w = r.choice(self.cued[kind])
                pre = (w.capitalize() if r.random() < 0.5 else f"{r.choice(['my', 'the', 'meine', 'le', 'mi', self.usual(), self.usual()])} {w}") + r.choice([" ", " ", " ", ", ", ": ", " to ", " a ", " à ", " an ", " with ", " por ", " - ", ". " if len(w) < 4 else " ", "\n"])
                post = r.choice([post, f" {self.plain()}.", f", {self.plain()}.", f" {self.usual()} {self.plain().lower()}.", f" {self.usual()} {r.choice(_NOUNS)}."])
            mention = kinds[kind](lang)
            x = r.random()
            if kind in ("name", "address") and x < 0.07:
                mention = mention.upper()
            elif kind in ("name", "address") and x < 0.19 and (pre or post) and not any(c in mention for c in "."):
                mention, pre, post = mention.lower(), pre.lower() if r.random() < 0.5 else pre, post
            tail: list = []
            if r.random() < 0.16:  # another way to reach the same person, right beside it
                other = r.choice(["phone", "email", "address", "id_number"])
                open_, close = r.choice([(" (", ")"), (", ", ""), (" - ", ""), (" <", ">"), (" / ", ""), (" ", ""), ("\n", ""), (" or ", ""), ("; ", "")])
                tail = [open_, (other, kinds[other](lang)), close]
            parts = [*_filled(pre, fill), (kind, mention), *tail, *_filled(post, fill)]
        else:
            parts = _filled(r.choice(_ANYWHERE) if r.random() < 0.25 else r.choice(PLAIN[lang]), fill)
        return parts

    def text(self) -> tuple[str, set[tuple[str, int, int]]]:
        """A text and the (kind, first character, end) of its mentions."""
        r = self.r
        lang = r.choices(list(_WEIGHTS), list(_WEIGHTS.values()))[0]
        gap = r.choice(["", "", "。"]) if lang == "ja" and r.random() < 0.6 else r.choice([" ", " ", " ", " ", "\n", "<br>", "  ", "\n\n"])
        text, truth = "", set()
        shout, small = r.random() < 0.06, r.random() < 0.06
        for _ in range(r.randrange(1, 8)):
            text += gap if text else ""
            loud = shout or r.random() < 0.06
            for part in self.sentence(lang):
                s = part[1] if isinstance(part, tuple) else part
                if isinstance(part, tuple):
                    if loud and part[0] in ("name", "address") and len(s.upper()) == len(s):
                        s = s.upper()
                    truth.add((part[0], len(text), len(text) + len(s)))
                elif loud and len(s.upper()) == len(s):
                    s = s.upper()
                elif small:
                    s = s.lower() if len(s.lower()) == len(s) else s
                text += s
        return text, truth


def _filled(template: str, fill: dict) -> list:
    parts: list = []
    while "{" in template:
        head, _, rest = template.partition("{")
        slot, _, template = rest.partition("}")
        parts += [head, fill[slot]()]
    return [*parts, template]


def usual_words(ranks: list[dict[bytes, int]], most: int = 6_000) -> tuple[list[str], list[str]]:
    """The most usual words of the vocabularies in turn, in small letters, and those that are only there with a capital."""
    small, capital = [], []
    for r in ranks:
        words = []
        for token, _ in sorted(r.items(), key=lambda x: x[1]):
            if token[:1] == b" " and len(token) > 2:
                try:
                    w = token[1:].decode()
                except UnicodeDecodeError:
                    continue
                if w.isalpha() and ord(w[0]) < 0x250:
                    words.append(w)
        small.append([w for w in words if w.islower()][:most])
        capital += [w for w in words if w.istitle() and len(w) > 2 and not any(f" {w.lower()}".encode() in r for r in ranks)]
    return [w for group in zip(*small) for w in group], sorted(set(capital))
