"""Sentences put down by hand, in other words than the training texts and with public names, mentions as [kind|text]. Nothing is trained or tuned on them."""

EN = """
[name|John Smith] never returned my drill.
Has anyone heard of [name|Rajesh Patel]? He fixed our roof.
The review was posted by [name|Maria Garcia] last winter.
I met [name|Wei Zhang] and her sister at the fair.
Everything was arranged by [name|Emily Johnson] in no time.
[name|Olga Ivanova] picked it up from the depot.
Complaints go to [name|Ahmed Hassan], [phone|020 7946 0123].
Our contact, [name|Priya Sharma], speaks four languages.
Kudos to [name|Liam O'Connor] for the quick fix!
Warm regards,
[name|Carmen Ruiz]
With thanks, [name|T. Anderson]
The form says [name|Walker, Susan] but that is not me.
Customer name: [name|Patel, R.]
According to [name|Dr. Who|]we should wait.
My landlord [name|David van der Berg] refuses to pay.
Signed, [name|Grace Kelly Morrison]
It was [name|Michael B. Jordan] on the phone, no doubt.
please tell [name|sarah connor] that the lid is cracked
MY COUSIN [name|PETER PARKER] ORDERED THREE OF THEM.
Reach me at [phone|(212) 736-5000] during office hours.
Leave a message: [phone|+1 415 555 2671].
our fax is [phone|01865 270000], nobody reads it
Text [phone|07700 900461] for a quote.
Switchboard [phone|0113 496 0999]; ask for sales.
Ring me back on [phone|+44 20 7946 0991], thanks.
Emergency contact [phone|617-495-1000].
My social security number is [id_number|536-22-8731], please delete it.
NI number [id_number|AB 12 34 56 C] was on the payslip.
Passport [id_number|C03005988] expires soon.
They scanned my driving licence, no. [id_number|K7712345].
The tax ID [id_number|219-09-9999] belongs to my father.
Our new home is [address|12 Harbour Parade], Brighton.
Visit us at [address|221B Baker Street], London.
The van stopped at [address|1600 Pennsylvania Avenue] instead.
Flat hunting ended at [address|7 Rosemary Lane].
Parcel shop: [address|45-47 High Road], open till nine.
I used to rent [address|Flat 3, 88 Queens Drive].
Billing address [address|10200 Lakeshore Boulevard] is wrong.
Drop it off at [address|5 Old Mill Close] please.
You may write to [email|jane.doe@example.org] for the manual.
Contact [email|support_team@helpful-tools.co.uk] first.
My mail is [email|bob (at) example (dot) com].
cc [email|h.simpson+orders@springfield.net]
Order 7741-2209 never shipped.
Invoice no. 2024/00871 was paid twice.
Part number AX-7730-12 does not fit the 2019 model.
EAN 4006381333931 is on the box.
Tracking number 1Z999AA10123456784 is invalid.
The Eiffel Tower model took 40 hours.
Summer Sale prices were great in San Diego.
I drove along Ocean Drive for two hours.
We ran it 24 hours at 230 V without trouble.
Anna loves the colour.
Great Product, Fast Shipping, Five Stars!
Happy New Year to the whole team.
Works with Windows Vista and Mac OS.
It cost 1,299.00 and weighs 12 kg.
Dear Customer Care, please answer.
Mount Everest would be easier to climb.
Not worth the money. Avoid!
"""
DE = """
[name|Klaus Müller] hat uns den Schrank aufgebaut.
Gestern rief [name|Sabine Krüger] endlich an.
Ein Lob an [name|Thomas Schäfer] aus der Werkstatt.
Zuständig war [name|Ayşe Yılmaz], sehr kompetent.
Es grüßt [name|Heinrich von Kleist]
Liebe Grüße
[name|Anke Petersen]
Unterschrift: [name|Becker, Jürgen]
Rechnung bitte an [name|Dieter Hoffmann], [address|Lindenallee 14], Köln.
Meine Nachbarin [name|Elke Sommer] ist begeistert.
Herr [name|F. Neumann] kam pünktlich.
Der Hausmeister heißt [name|Georg Wagner].
frau [name|petra lehmann] meldet sich nicht
[name|Wolfgang A. Mozart] steht auf dem Klingelschild.
Ich habe [name|Matthias Reim] am Schalter getroffen.
Die Beraterin ([name|Ingrid Bauer]) war freundlich.
Telefonisch bin ich unter [phone|0221 4710 123] zu sprechen.
Meine Handynummer lautet [phone|0171 2345678].
Rufen Sie [phone|+49 89 636 48018] an.
Fax: [phone|030/8104-5520]
Zentrale [phone|(069) 2123-4567], bitte warten.
Die Steuer-ID [id_number|65 929 970 489] hätte niemand sehen dürfen.
Mein Reisepass hat die Nummer [id_number|C01X00T47].
Personalausweis [id_number|L01X00T471] wurde kopiert.
Sozialversicherungsnummer: [id_number|65 180539 W 008]
Wir wohnen jetzt [address|Hauptstraße 5b], Hinterhaus.
Abgegeben in der [address|Goethestr. 112].
Lieferort: [address|Am Markt 3], Bremen.
Das Büro liegt [address|Berliner Straße 48].
Bitte an den [address|Kiefernweg 9] schicken.
Er zog in die [address|Friedrich-Ebert-Allee 221].
Treffpunkt ist der [address|Rosenplatz 1].
Anfragen an [email|info@muster-shop.de] bleiben liegen.
Schreiben Sie bitte [email|k.mueller[at]beispiel[dot]de].
Meine Adresse: [email|anna_weber99@posteo.example]
Die Bestellnummer 4711-0815 ist falsch.
Artikel 883920 passt nicht zur Serie 7.
Rechnung RE-2023-1182 fehlt.
Barcode 4001234567890 nicht lesbar.
Gute Verarbeitung, schöner Griff, schnelle Lieferung.
Am Montag bestellt, am Freitag geliefert.
Der Deckel ist aus Holz, der Boden aus Stahl.
Mein Sohn Paul spielt jeden Tag damit.
Im Schwarzwald war es kalt.
Die Waschmaschine läuft mit 1400 Umdrehungen.
Frohe Weihnachten und ein gutes Neues Jahr!
Preis und Leistung stimmen hier nicht.
Nie wieder bei diesem Händler.
Hannover Messe war gut besucht.
Sehr geehrte Damen und Herren, so geht das nicht.
"""
FR = """
[name|Pierre Dubois] m'a rappelé le lendemain.
Le gérant, [name|Jean-Luc Moreau], s'est excusé.
Merci beaucoup à [name|Nathalie Lefebvre] de l'accueil.
Ma sœur [name|Camille Laurent] en a deux.
Bonne journée,
[name|Hélène Girard]
Dossier suivi par [name|Benoît Marchand].
Veuillez livrer chez [name|Dupont, Sylvie], [address|14 rue des Acacias].
Mme [name|C. Fontaine] ne travaille plus ici.
Salutations, [name|Antoine de Saint-Exupéry]
Nous avons rencontré [name|Fatou Diop] au salon.
Son vrai nom est [name|Marguerite Yourcenar].
L'électricien s'appelle [name|Karim Benzema].
un certain [name|michel leblanc] a signé à ma place
J'ai transmis la photo à [name|Sophie Marceau].
[name|Olivier Roux] et [name|Chloé Blanc] confirment.
Vous pouvez m'appeler au [phone|01 42 68 53 00].
Mon portable est le [phone|06 12 34 56 78].
Standard : [phone|+33 1 44 55 66 77]
Fax [phone|04.91.13.89.00]
Rappelez-moi, [phone|0238456712], après 19 h.
Mon numéro de sécurité sociale, [id_number|2 69 05 49 588 157 80], figurait dessus.
Passeport [id_number|12AB34567] périmé.
Numéro fiscal [id_number|30 23 217 600 053] demandé deux fois.
Carte nationale [id_number|880692310285] refusée.
Nous habitons [address|8 bis avenue Victor Hugo].
Le magasin se trouve [address|25, rue de la République].
Déposé au [address|3 impasse des Lilas] par erreur.
Siège social : [address|102 boulevard Haussmann].
Mon ancienne adresse, [address|17 chemin du Moulin], est encore utilisée.
Rendez-vous [address|1 place Bellecour].
Il faut écrire à [email|contact@exemple.fr].
Mon courriel : [email|jp.martin@laposte.example]
Envoyez tout à [email|marie (at) exemple (dot) org].
Ma commande 90-22318 est perdue.
Facture F2023-778 réglée.
La référence 55102 n'existe plus.
Code-barres 3017620422003.
La livraison a pris trois semaines.
Bonne qualité, bon prix, emballage soigné.
Ma fille Zoé adore la couleur.
Nous avons visité le Mont Saint-Michel.
Il fonctionne sous 230 V et pèse 3 kg.
Joyeux Noël et Bonne Année à tous.
Service Après-Vente injoignable.
Le couvercle ferme mal, dommage.
Je ne recommande pas du tout.
Chère équipe, merci de répondre.
"""
ES = """
[name|Carmen Ruiz] me cambió la pieza sin coste.
El jefe de tienda, [name|Javier Moreno], pidió disculpas.
Estoy muy agradecida a [name|Lucía Fernández].
Mi prima [name|Rosa Delgado] tiene el mismo.
Un abrazo,
[name|Pablo Ortega]
Lo firmó [name|Sánchez, Miguel] en mi lugar.
Pregunte por [name|Isabel Allende] en caja.
El cartero, [name|J. Navarro], no llamó.
Enviar a nombre de [name|María del Carmen Soto].
Nos visitó [name|Andrés Iniesta] el lunes.
Atentamente, [name|Gabriela Mistral]
[name|Raquel Torres] y [name|Hugo Ramos] opinan lo mismo.
hablen con [name|ana belén prieto] si no me creen
Mi cuñado [name|Francisco Javier Vega] lo montó.
Vendedora: [name|Elena Campos]
Pueden llamarme al [phone|612 34 56 78].
Mi fijo es [phone|91 456 78 90].
Teléfono de contacto: [phone|+34 933 17 45 20]
Fax [phone|954 123 456]
Marque el [phone|(956) 220-145] por las mañanas.
Mi DNI es [id_number|12345678Z] y no quiero que conste.
NIE [id_number|X1234567L] caducado.
Pidieron el pasaporte, [id_number|AAB123456], en la puerta.
El documento [id_number|45.872.310-K] apareció en la etiqueta.
Vivimos en la [address|Calle Mayor, 23], tercero.
Mi oficina está en [address|Avda. de América 115].
Recogida en [address|Plaza España 4].
Lo dejaron en [address|C/ Serrano, 61], que no es la mía.
Antes vivía en el [address|Paseo del Prado, 8].
Tienda: [address|Gran Vía 32|]
Escriban a [email|ventas@ejemplo.es] sin miedo.
Mi correo es [email|l.gomez_1980@correo.example].
Contacto: [email|pedro [arroba] ejemplo.com|]
El pedido 33-90817 no llegó.
Factura A/2023/551 pagada.
La referencia 77120 está agotada.
Código de barras 8410376009408.
Buena calidad, buen precio, envío rápido.
A mi hijo Mateo le encanta.
Fuimos a Costa Brava con él.
Funciona a 230 V y pesa 4 kg.
Feliz Navidad y Próspero Año Nuevo.
Servicio Técnico pésimo.
La tapa no encaja bien.
No lo volvería a comprar.
Estimado equipo, espero respuesta.
Semana Santa fue tranquila.
"""
JA = """
[name|田中太郎]さんが修理してくれました。
窓口の[name|鈴木一郎]様はとても親切でした。
担当の[name|佐藤美咲]です。
送り主は[name|山本健二]と申します。
[name|高橋 直子]さんに聞いてください。
店長の[name|伊藤誠]氏から連絡がありました。
友人の[name|小林さくら]も同じ物を使っています。
[name|マリア・ガルシア]さんからの贈り物です。
[name|John Smith]さんが組み立てました。
氏名:[name|渡辺 大輔]
[name|中村由美子]先生に勧められました。
隣人の[name|加藤修]さんが受け取りました。
電話は[phone|03-1234-5678]です。
携帯[phone|090-8765-4321]までお願いします。
連絡先は[phone|０６-６３４５-６７８９]です。
お問い合わせは[phone|0120-444-113]へ。
マイナンバーは[id_number|1234 5678 9012]です。
旅券番号[id_number|TK1234567]を書かされました。
免許証番号[id_number|305012345670]が見えていました。
住所は[address|東京都千代田区丸の内1-9-1]です。
返品先:[address|大阪府大阪市北区梅田3-1-3]
[address|京都市左京区吉田本町36番1号]に届けてください。
メールは[email|taro.tanaka@example.jp]です。
[email|info＠rei.example]へ送ってください。
注文番号は8812-0034です。
型番はKX-9920です。
請求書番号2023-118が間違っています。
品質は良いです。配送も早かったです。
店員さんはとても親切でした。
お客様センターに電話しました。
配送業者さんが雨の中を運んでくれました。
京都と大阪で使いました。
価格は3980円でした。
娘の花子も喜んでいます。
説明書が分かりにくいです。
二度と買いません。
皆様にお勧めします。
日本製だと思いました。
色もサイズも希望通りです。
"""
SENTENCES = {"en": EN, "de": DE, "fr": FR, "es": ES, "ja": JA}


def parsed(line: str) -> tuple[str, set[tuple[str, int]]]:
    """The plain sentence and the (kind, first character) of its mentions. A mention that ends in | is not counted."""
    text, truth = "", set()
    while (at := line.find("[")) >= 0 and "|" in line[at:]:
        kind = line[at + 1 : line.index("|", at)]
        if kind not in ("name", "phone", "id_number", "address", "email"):
            text, line = text + line[: at + 1], line[at + 1 :]
            continue
        text += line[:at]
        end, depth = at + len(kind) + 2, 0
        while line[end] != "]" or depth:
            depth += (line[end] == "[") - (line[end] == "]")
            end += 1
        mention = line[at + len(kind) + 2 : end]
        if mention.endswith("|"):
            mention = mention[:-1]
        else:
            truth.add((kind, len(text)))
        text, line = text + mention, line[end + 1 :]
    return text + line, truth


def cases() -> list[tuple[str, str, set[tuple[str, int]]]]:
    return [(lang, *parsed(line)) for lang, block in SENTENCES.items() for line in block.strip().split("\n")]
