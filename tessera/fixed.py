"""Word lists, tables, patterns and formats that results depend on.

Patterns are in Java's dialect: (?iuU) where case counts for nothing, (?U) for
Unicode classes, (?d) so that only a line feed ends a line.
"""

# Letters folded to ASCII for matching.
FOLD_FROM = "çğıöşüÇĞİÖŞÜâîûÂÎÛ"
FOLD_TO = "cgiosuCGIOSUaiuAIU"

# Stop words, folded.
STOP_WORDS = frozenset(
    "ve veya ile ya ancak fakat ama bu su o bir birer her hic tum butun icin gibi gore kadar sonra once "
    "uzere ise de da ki mi mu ne nedir nasil hangi kim kimdir olan olarak olur eden edilir yapilir "
    "en cok az daha ayrica".split()
)

# Suffixes, in the order they are tried.
SUFFIXES = (
    "lerinin larinin lerini larini lerin larin leri lari ndan nden nin nun tan ten dan den "
    "ler lar in un ye ya yi yu de da te ta si su i e a u"
).split()

# Letters that Turkish text has, and signs of text decoded wrongly.
TURKISH_LETTERS = "ıİşŞğĞüÜöÖçÇ"
MOJIBAKE = ("Ã¼", "Ã¶", "Ã§", "Ãı", "Å", "Ä°", "Ä±", "Ã\x9c", "ÃÂ")

# Headings of articles and marks of their items.
ARTICLE = (
    r"(?iuUmd)^[ \t]*(geçici\s+madde|ek\s+madde|madde)\s*"
    r"(\d+(?:\s*/\s*[A-ZÇĞİÖŞÜa-zçğıöşü])?)\s*([–\-—.:]|\s)\s*"
)
ITEM = r"(?Umd)^[ \t]*(?:\((\d+)\)|([a-zçğıöşü])\)|(\d+)\))\s+"
ARTICLE_KINDS = {"madde": "MADDE", "geçici madde": "GEÇİCİ MADDE", "ek madde": "EK MADDE"}

# Lines that mark a document's type, and lines before a title.
TYPE_MARKERS = {
    "kanun": "Kanun",
    "yönetmelik": "Yönetmelik",
    "yönetmeli̇k": "Yönetmelik",
    "tebliğ": "Tebliğ",
    "kurul kararı": "Kurul Kararı",
    "bakanlar kurulu kararı": "Kurul Kararı",
    "cumhurbaşkanı kararı": "Kurul Kararı",
    "usul ve esaslar": "Usul ve Esaslar",
}
PREAMBLE = (
    r"(?iuU)\A\s*(?:[\w\s]*kurumundan\s*:?|[\w\s]*bakanlığından\s*:?|resm[iî]\s*gazete.*"
    r"|karar\s*(?:no|sayısı)\s*[:.].*|kanun\s*(?:no|numarası)\s*[:.].*|kabul\s*tarihi\s*[:.].*"
    r"|yayım(?:landığı)?\s*.*|karar\s*tarihi\s*[:.].*|amaç(?:\s*ve\s*kapsam)?|dayanak)\s*\Z"
)
MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")
GAZETTE_BANNER = (
    r"(?iuUs)(\d{1,2})\s+([A-Za-zÇĞİÖŞÜçğıöşü]+)\s+(\d{4}).{0,40}?resm[iî]\s*gazete.*?say[ıi]\s*[:：]?\s*(\d+)"
)
GAZETTE_FIELD = (
    r"(?iuUs)yayım(?:landığı)?\s*(?:r\.?\s*|resm[iî]\s*)?gazete\s*[:：]?\s*(?:tarih\s*[:：]?\s*)?"
    r"(\d{1,2}[./]\d{1,2}[./]\d{4}).{0,30}?say[ıi]\s*[:：]?\s*(\d+)"
)
GAZETTE_INLINE = r"(?iuU)(\d{1,2}[./]\d{1,2}[./]\d{4})\s*tarih(?:li)?\s*ve\s*(\d+)\s*say[ıi]l[ıi]\s*resm[iî]?\s*gazete"
GAZETTE_LINE = r"(?iuU)\A\s*\d{1,2}\s+\S+\s+\d{4}\b.*resm[iî]\s*gazete"
NUMBERS = (
    r"(?iuU)kanun\s*(?:no|numarası)\b[\s.:：]{0,8}(\d{3,5})",
    r"(?iuU)karar\s*(?:no|sayısı)\b[\s.:：]{0,8}([\d/\-]+)",
    r"(?iuU)mevzuat\s*no\b[\s.:：]{0,8}(\d+)",
)
TITLE_TYPES = (
    (r"(?U)\busul\s+ve\s+esas\w*", "Usul ve Esaslar"),
    (r"(?U)\byönetmeli[kğ]\w*", "Yönetmelik"),
    (r"(?U)\btebli[ğg]\w*", "Tebliğ"),
    (r"(?U)\bkurul\s+karar\w*", "Kurul Kararı"),
    (r"(?U)\bkarar(?!name)\w*", "Kurul Kararı"),
    (r"(?U)\bkanun\w*", "Kanun"),
)
CONTAINED_TYPES = (("yönetmelik", "Yönetmelik"), ("tebliğ", "Tebliğ"), ("kanun", "Kanun"))
TRAILING_FIELD = (
    r"(?iuU)\s+(?=Kanun\s*(?:No|Numarası)\b|Karar\s*(?:No|Sayısı|Tarihi)\b|Kabul\s*Tarihi\b|Yayım(?:landığı)?\b"
    r"|Resm[iî]\s*Gazete\b|(?:GEÇİCİ\s+|EK\s+)?MADDE\s+\d|Amaç\b)"
)
ISSUER = r"(?iuU)\A\s*[\w\s.]*?(?:Kurumundan|Bakanlığından|Kurulundan)\s*:\s*"

# Documents excluded by hand, and documents that amend many laws.
EXCLUSIONS = (
    (
        "Nükleer Düzenleme Kanunu (7381)",
        "Nuclear safety law of another authority; outside electricity-market regulation.",
        r"(?iuU)n[üu]kleer\s+d[üu]zenleme\s+kanunu|kanun\s+no\.?\s*7381",
    ),
)
OMNIBUS_TITLE = (
    r"(?iuU)baz[ıi]\s+(?:vergi\s+)?kanun|di[ğg]er\s+baz[ıi]\s+kanun|b[üu]t[çc]e\s+kanunlar[ıi]nda\s+yer\s+alan\s+baz[ıi]"
)
OMNIBUS_BODY = (
    r"(?iuU)(?:di[ğg]er\s+)?baz[ıi]\s+(?:vergi\s+)?kanun\w*(?:\s+\S+){0,8}?\s+de[ğg]i[şs]iklik\s+yap[ıi]lmas[ıi]"
)
LAW_CODE = r"(?iuU)\b(\d{3,5})\s*say[ıi]l[ıi]"

# Law codes of the domain and of other fields.
DOMAIN_CODES = "6446 4628 5346 3096 4283 5627 2819 6094 7257".split()
OTHER_CODES = (
    "213 193 5520 3065 4760 488 492 7338 1319 6183 657 375 5510 4447 926 4857 1475 6356 854 5953 "
    "5237 5271 5275 2004 6100 2577 2575 2802 5326 2918 4721 5490 2547 2809 1111 3359 3213 2804 6491 4646 "
    "5015 5307 5996 5199 5488 2634 2863 3289 6136 5411 6362 5684 5809 6112"
).split()

# Terms of the domain; one of them counts twice.
DOMAIN_TERMS = (
    "elektrik", "elektrik enerjisi", "elektrik piyasası", "enerji piyasası",
    "enerji bakanlığı", "enerji ve tabii kaynaklar",
    "epdk", "teiaş", "tedaş", "eüaş", "tetaş", "epiaş", "epiaş",
    "dağıtım şirketi", "dağıtım bölgesi", "dağıtım lisansı", "dağıtım sistemi",
    "dağıtım bedeli", "dağıtım faaliyeti", "dağıtım tesisi",
    "iletim sistemi", "iletim şirketi", "iletim faaliyeti", "iletim tarifesi",
    "üretim tesisi", "üretim lisansı", "üretim şirketi", "üretim faaliyeti",
    "önlisans", "ön lisans", "lisanssız üretim", "lisanssız elektrik",
    "tedarik lisansı", "tedarikçi", "görevli tedarik", "son kaynak tedarik",
    "perakende satış", "serbest tüketici", "abone", "abonelik",
    "kwh", "mwh", "gwh", "megavat", "kilovat", "mw", "kv",
    "gerilim", "trafo", "transformatör", "şebeke", "sayaç", "osos",
    "dengeleme", "uzlaştırma", "gün öncesi piyasası", "dengeleme güç piyasası",
    "yekdem", "yek-g", "yenilenebilir enerji", "rüzgâr", "rüzgar",
    "güneş enerjisi", "hidroelektrik", "jeotermal", "biyokütle",
    "kojenerasyon", "santral", "santrali", "enterkonneksiyon",
    "kapasite mekanizması", "piyasa işletmecisi", "yan hizmet",
    "sistem kullanım", "bağlantı anlaşması", "elektrik tüketimi",
    "elektrik üretimi", "elektrik tarifesi", "kayıp kaçak", "puant",
)

# Terms of other fields.
OTHER_TERMS = (
    "vergi usul kanunu", "gelir vergisi", "kurumlar vergisi", "katma değer vergisi",
    "damga vergisi", "veraset ve intikal", "emlak vergisi", "motorlu taşıtlar vergisi",
    "vergi dairesi", "vergi levhası", "beyanname", "matrah", "mükellef",
    "vergi ziyaı", "tarhiyat", "gelir idaresi başkanlığı", "varlık barışı",
    "devlet memurları kanunu", "memuriyet", "kadro ihdas", "ek gösterge",
    "aylık ve özlük", "özlük hakları", "sözleşmeli personel", "kadro unvan",
    "657 sayılı", "375 sayılı kanun hükmünde kararname",
    "sosyal sigortalar", "sosyal güvenlik kurumu", "emekli aylığı", "prim borcu",
    "5510 sayılı", "genel sağlık sigortası",
    "kıdem tazminatı", "ihbar tazminatı", "iş sözleşmesi", "iş kanunu",
    "sendika", "toplu iş sözleşmesi", "grev", "lokavt", "asgari ücret",
    "işçi ve işveren", "4857 sayılı", "6356 sayılı",
    "türk ceza kanunu", "ceza muhakemesi", "adlî kontrol", "tutuklama",
    "infaz", "hükümlü", "cumhuriyet savcı", "ceza zamanaşımı",
    "icra ve iflas", "haciz", "hukuk muhakemeleri", "idari yargılama usulü",
    "5271 sayılı", "5237 sayılı", "2004 sayılı icra",
    "karayolları trafik", "trafik cezası", "sürücü belgesi", "araç tescil",
    "trafik para cezası", "2918 sayılı",
    "türk medeni kanunu", "velayet", "nafaka", "boşanma", "nüfus hizmetleri",
    "evlenme", "miras",
    "yükseköğretim", "öğretim üyesi", "milli eğitim", "öğrenci affı",
    "sağlık bakanlığı", "hastane", "eczane", "ilaç fiyat",
    "askerlik", "türk silahlı kuvvetleri", "jandarma",
    "gıda tarım ve hayvancılık", "hayvancılık destek", "tarımsal destekleme",
    "bitki sağlığı", "veteriner",
    "spor federasyon", "futbol", "sporcu", "kültür ve turizm",
    "turizm işletmesi belgesi", "turizm yatırımı", "plaj işletme",
    "ateşli silah", "yivsiz tüfek", "tabanca",
    "bankacılık kanunu", "sermaye piyasası kurulu", "sigortacılık kanunu",
    "elektronik haberleşme", "evrensel hizmet", "hazine payı", "telsiz ücreti",
    "maden ruhsat", "ruhsat sahibi", "maden sahası", "işletme ruhsatı",
    "arama ruhsatı", "devlet hakkı", "ocak başı satış", "rödovans",
    "madencilik faaliyet", "maden kanunu",
    "doğal gaz piyasası", "petrol piyasası", "akaryakıt", "lpg",
    "rafineri", "boru hattı", "petrol arama", "sıvılaştırılmış petrol",
    "nükleer madde", "radyoaktif", "nükleer tesis",
)

# What is taken out of a source text before a model sees it, in order.
REDACTED = "[…]"
_UPPER = "KANUN|YÖNETMELİK|YÖNETMELİĞ|TEBLİĞ|TEBLIG|KARARNAME|KARAR|GENELGE|TALİMAT|ESASLAR|USUL|KHK"
_MIXED = "Kanun|Yönetmelik|Yönetmeliğ|Tebliğ|Teblig|Kararname|Karar|Genelge|Talimat|Esaslar|Usul"
SCRUB = (
    r"(?iuU)\(\s*(?:Değişik|Degisik|Ek|Mülga|Mulga|Yeniden\s+düzenleme|İptal)\s*:?\s*[^()]*?RG[^()]*\)",
    r"(?U)RG\s*-\s*\d{1,2}[./]\d{1,2}[./]\d{2,4}\s*-\s*\d+",
    r"(?iuU)Resm[îi]\s*Gazete(?:'?\w*)?",
    r"(?U)(?:(?:GEÇİCİ|GECICI|EK|Geçici|Gecici|Ek)\s+)?(?:MADDE|Madde|madde)\s*\d+\s*(?:/\s*[A-Za-zÇĞİÖŞÜçğıöşü])?",
    r"(?iuU)(?:(?:geçici|gecici|ek)\s+)?\d+\s*(?:inci|ıncı|nci|ncı|uncu|üncü|ünci)\s+madde\w*",
    r"(?iuU)(?:birinci|ikinci|üçüncü|dördüncü|beşinci|altıncı|yedinci|sekizinci|dokuzuncu|onuncu)\s+madde\w*",
    r"(?iuU)\d{3,6}\s*say[ıi]l[ıi]\s*\w*",
    r"(?iuU)(?:Kanun|Karar|Kararname|Yönetmelik|Tebli[ğg]|Say[ıi])\s*(?:No|Numaras[ıi])\s*\.?\s*:?\s*\d+",
    rf"(?U)(?:[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜ0-9'’]*\s+){{1,12}}(?:{_UPPER})\w*",
    rf"(?U)(?:[A-ZÇĞİÖŞÜ][a-zçğıöşü]+\s+){{1,8}}(?:{_MIXED})\w*",
    rf"(?U)(?:Bu|Aynı|Ayni|İlgili|Ilgili|Söz\s+konusu)\s+(?:{_MIXED})\w*",
    r"(?U)\d{1,2}\s*[./]\s*\d{1,2}\s*[./]\s*\d{2,4}",
    r"(?iuU)\d{1,2}\s+(?:Ocak|Şubat|Subat|Mart|Nisan|Mayıs|Mayis|Haziran|Temmuz|"
    r"Ağustos|Agustos|Eylül|Eylul|Ekim|Kasım|Kasim|Aralık|Aralik)\s+\d{4}",
)
SCRUB_RUN = r"(?U)(?:\[…\]\s*){2,}"
SCRUB_SPACE = r"[ \t]{2,}"

# Labels of sources in prompts and answers.
LABEL_WORD = "KAYNAK"
LABEL_RUN = r"(?iuU)KAYNAK\s*((?:\d+\s*(?:,|ve|ile|/|&|-)\s*)*\d+)"
LABEL_MENTION = r"(?iuU)\[?\s*KAYNAK\s*\d+(?:\s*(?:,|ve|ile)\s*\d+)*\s*\]?"
HEADING_LINE = r"(?U)\A\s*(?:#{1,6}\s*)?\*{0,2}[^\n.!?]{0,120}\*{0,2}\s*\Z"

# Follow-up questions and rewrites.
FOLLOW_UP = (
    "peki bu bunun buna bunda bundan bunlar bunlari su sunun o onun ona onda ondan onlar "
    "ayni soz konusu ayrica istisnasi istisna digeri oteki yukaridaki bahsedilen belirtilen"
).split()
FEW_CONTENT_WORDS = 2
FRESH = "YENİ"
LEADING_NAME = r"(?iuU)\A(?:\s*(?:SON\s*SORU|YENİ\s*SORU|SORU|Yeniden\s*yaz[ıi]lm[ıi]ş\s*soru|Cevap)\s*[:\-]\s*)+"
ANSWER_SHAPED = r"(?iuU)\A\s*(?:evet|hayır|hayir|elbette|maalesef)\b"

# Signs of a prompt too long for the model's server, in the text of its error.
CONTEXT_ERRORS = (
    "out of memory", "cudamallocarray", "context_length", "context length",
    "maximum context", "too many tokens", "prompt is too long",
)
