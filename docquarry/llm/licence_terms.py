"""Term counts of whole licence texts: how often each term occurs, terms of one count together, in order."""

from __future__ import annotations

_LISTED = {
    "Apache-2.0": {
        1: "2 2004 3 4 5 50 6 7 8 above acceptance act acting acts addendum additions advised agree agreement alleging alone along alongside also annotations appear applies appropriate appropriateness archives arising asserted associated assume attach attached available b based below beneficial bind boilerplate c cannot carry changed character choose claim class combination comment commercial common compiled compliance complies computer configuration consequential consistent conspicuously constitutes construed contained content contents contributory controlled conversions copies counterclaim cross customary d date defend defined definitions deliberate derived describing description designated determining different direction disclaimer discussing document does don easier editorial elaborations end entities even event example executed exercise exercising explicitly failure fee fields fifty filed fitness format give goodwill governing granting grossly harmless herein hold how however i identification identifying ii iii import improving inability incidental includes incurred indemnify indemnity indicated information informational infringed institute interfaces issue january language lawsuit least liable licensable licensed limitations link lists loss losses mailing make making malfunction managed management marked marks mechanical media medium meet merchantability merely modified modifying more necessarily negligence negligent normally nothing notwithstanding obtain one origin out outstanding page particular percent perform permission places possibility power preferred prepare printed product prominent provide readable reason reasonable received recipients recommend redistribution regarding remain replaced represent representatives reproducing responsibility responsible result resulting retain revisions rights risks same section sections see sent separable separate service shares should sole solely special specific state statement stating stoppage sublicense submission submit subsequently supersede support syntax t terminate theory through title tort tracking trade trademark transfer transformation translation types union using verbal was we where wherever while whom written yyyy",
        2: "1 9 add against appendix apply at authorized basis been brackets cause claims contract definition display either electronic enclosed exclusive express free generated granted grants has have hereby http implied included inclusion incorporated indirect infringement intentionally irrevocable kind limitation litigation made means modify names obligations offer org original ownership party perpetual pertain provides publicly redistributing reproduce royalty sell software stated subject systems their then third trademarks which whole worldwide www",
        3: "2.0 accepting agreed all applicable authorship charge code communication contributions copy direct distributed do documentation except excluding files following grant include individual its law licenses name non permissions purpose s those version warranties",
        4: "attribution control each limited must no only own part purposes reproduction required submitted text thereof unless warranty whether writing",
        5: "additional be behalf but damages distribute distribution from legal liability provided without",
        6: "apache are if modifications object otherwise owner",
        7: "an other patent",
        8: "contribution file notices within",
        9: "including may notice terms under",
        10: "contributor entity is licensor mean use",
        11: "on with",
        12: "not source",
        13: "conditions copyright form your",
        15: "shall",
        17: "as this",
        18: "derivative such",
        19: "works",
        22: "a that",
        23: "by",
        24: "for in",
        26: "you",
        30: "any",
        34: "work",
        35: "license",
        40: "to",
        46: "and",
        67: "of",
        69: "or",
        100: "the",
    },
    "BSD-2-Clause": {
        1: "1 2 a advised arising as be business by caused code consequential contract damage damages data direct disclaimed distribution documentation even event exemplary express fitness form forms goods however if incidental indirect interruption liable loss materials merchantability met modification negligence no on other otherwise out particular permitted possibility procurement profits purpose redistribution reproduce retain services shall special strict substitute such that theory tort way whether without",
        2: "above binary but contributors copyright disclaimer for implied is liability limited list must not notice redistributions regents software source to warranties with",
        3: "are conditions following including provided use",
        4: "any this",
        6: "in",
        9: "and",
        10: "or",
        11: "of",
        12: "the",
    },
    "BSD-3-Clause": {
        1: "1 2 3 a advised arising as business by caused code consequential contract damage damages data derived direct disclaimed distribution documentation endorse even event exemplary express fitness form forms from goods however if incidental indirect interruption its liable loss materials may merchantability met modification name names negligence neither no nor on other otherwise out particular permission permitted possibility prior procurement products profits promote purpose redistribution reproduce retain services shall special specific strict substitute such that theory tort university used way whether written",
        2: "above be binary but copyright disclaimer for implied is liability limited list must not notice redistributions regents source warranties with without",
        3: "are conditions contributors following including provided software to use",
        4: "any",
        5: "this",
        6: "in",
        9: "and",
        11: "or",
        13: "of",
        15: "the",
    },
    "CC0-1.0": {
        1: "1 1.0 11 1996 2 3 9 96 abandoned abandons account accuracy acknowledges adapt addition additional affirms against amended applied arising assert associating at attorney author authorship automatically available b based basis benefit build c can cancellation certain clearing client code communicate compensation competition concerning confer consents consideration contemplated contrary contravention contribute contributing corporation corresponding council create creator culture d damages data databases date deemed defects defined depicted detriment disclaimers discoverable display disrupt dissemination duty ec effect effective efforts either elects enjoyment equitable equivalent errors european existing expectation extraction fallback fear firm fitness following form freely from gain grants greater has heirs held ideal image implementation implementations implied include incorporate ineffectiveness intended intending into invalidate invalidity irrevocable irrevocably its jurisdictions kind knowledge known large latent later laws liability licensed likeness limited made march meaning member merchantability modify moral most motivations necessary neighboring now obligation obtaining offers others overtly paragraph parliament partial particular party patent perform performer permissible permissions persons pertaining possible present preserved privacy production promote protected protection provide provides publicity publicly quiet redistribute regarding regards relationship reliably relinquish remainder remaining representations reproduce reputation required rescission resulting retained revocation right royalty services similar so statutory sublicensable subsequent successor successors surrendered surrenders taking termination terms their then through title trademark transferable translate unconditional unconditionally understands unfair universal unknown v version vi vii voluntarily waived waives was well will wish",
        2: "4 absence advertising affected apply are associated below but case copies cultural current database directive distribute distribution does duration exclusive exercise extensions free fully further greatest he her hereunder his ineffective infringement invalid legally limitations medium national number original otherwise owners permanently permitted promotional protecting reason respect responsibility reuse scientific she should subject territories these throughout time upon whether world worldwide",
        3: "causes commercial disclaims hereby iii information iv judged makes maximum may owner part thereof those treaty warranties whatsoever",
        4: "action claims each express i ii no non on person provided public shall statement with",
        5: "all an document extent future legal limitation purposes such works",
        6: "be is license that",
        7: "0 applicable cc creative other this under use waiver without",
        8: "commons law purpose",
        9: "as including",
        10: "by not",
        11: "copyright related s",
        17: "affirmer",
        18: "a for",
        21: "in",
        22: "rights",
        24: "any",
        26: "work",
        29: "to",
        45: "or",
        50: "of",
        55: "and",
        66: "the",
    },
    "GPL-2.0": {
        1: "0 10 11 12 3 4 5 6 69 7 8 9 absence absolutely acceptance accompanies accord achieve actions activities addition address addressed advised aggregation agreed agreement allegation alter alternative among anyone anything application applications appropriately april arising associated assume attempt avoid away balance because being believed below best binary body both brief bring called carry case changed changing choice choose circumstance circumstances claim clicks collective comes commit compelled compilation compiler compilers component components concerns consequential consider considered consistent conspicuously constantly constitute contact containing contents contradict contrast contributions convey correction counts course danger date decide decision defective definition deny depends derivatives designated detail develop differ different directly disclaims display distinguishing document donor effect effectively electronic employer end enforcing equivalent event ever every exceptions exchange excluded excluding exclusion excuse explicit expressed expressly extend extent failure finally follow forbid forming found further generally generous geographical given gives goals granted grants gratis greatest guarantee guided hacker having he held here hereby herein hereinafter holders hope hypothetical idea identifiable implemented imposed inability inaccurate incidental include included incorporate incorporates incorporating indicate indirectly individually induce infringe infringement installation intact integrity interactively interest interface interfaces introduced invalid issues items james judgment june keep kernel kind language legal liable licensees licensor like linking long loss losses mail major makes many meet menu mere mode modules mouse names noncommercial nothing obtain operate operating order ordinary others ours out outside paper passed passes people performance performing permissions pertinent physical physically pieces placed places pointer possibility possible practices preamble precise preferred present preserving president prevent price programmer prohibited prominent promoting property protecting prove quality range rather reads reason reasonably receives recipient redistribution redistributors refer referring refers reflect refrain regardless reliance remain rendered repair reputations requirements responsibilities responsible rest reuse revised risk royalty run runs safest sample say school scripts see service servicing sharing she short sign signature signed similar simultaneously since sole some someone something sometimes speak specifies specify spirit start started starts stated stating status steps storage subject subroutine subsection suits surrender sustained take telling term terminate terminated themselves therefore thereof things thoroughly though threatened three transferring translate translated translation true understands unenforceable up user using valid validity vice view void volume warranties welcome whatever where wide willing wrote years yoyodyne",
        2: "02110 1301 1989 1991 51 accept access act add allowed another applicable ask attach authors automatically been boston cannot claims clear compliance contest control coon copyrighted cost could court customarily data derived designed disclaimer distributing entire entirely example except exception exercise fifth file fitness floor franklin full has impose independent information instead intent interchange itself least lesser library licensee line ma machine making merchantability modifying necessary need obligations offering one output parts place plus problems protect protection provide readable restricted right same satisfy saying scope separate share special street sublicense their too two ty type unless usa useful users versions would writing year",
        3: "accompany along announcement applies appropriate b cause commands complete consequence contains corresponding countries covered damages derivative details else fee files following get gnomovision how however implied inc into know later limitation limited means modifications more name normally notices number option otherwise our particular party patents permission permit portion print proprietary publish published required restrictions running sure than them there those through time used verbatim w way whether whose wish write",
        4: "certain copying even everyone form freedom give holder including intended interactive law licensed licenses made medium modification modified most object original part permitted provided purpose receive received recipients then thus without written",
        5: "also author change charge offer only patent s should system third want what who works",
        6: "above apply does new notice programs redistribute sections they",
        7: "1 but distributed either executable its parties when whole",
        8: "2 at c can copies do each gnu no show so will",
        9: "an make modify must section use we",
        10: "foundation from which",
        11: "have rights these",
        12: "based such",
        13: "are conditions version warranty",
        14: "all copyright",
        15: "general",
        16: "be code distribution public source",
        17: "may with",
        18: "copy other terms",
        19: "distribute under",
        20: "your",
        21: "as",
        24: "work",
        26: "on",
        28: "by free",
        29: "in",
        32: "if",
        34: "not",
        35: "software that",
        38: "any",
        39: "for it",
        46: "license",
        49: "this",
        53: "is",
        57: "a",
        71: "program",
        72: "and",
        76: "you",
        77: "or",
        104: "of",
        108: "to",
        194: "the",
    },
    "GPL-3.0": {
        1: "0 12 14 17 1996 20 28 29 30 60 8 9 ability about absence absolute absolutely abuse accessible accompanies according achieve acknowledges across actions activity actual actually adapt address addressed adopted adversely advised affects affirmed affirms agree agreed aim alleging allow already alternative although among ancillary anti applications applied appropriately approximates area arise arising article asking assert assets associated assume assumption assures attempt attributed attributions authorization authorized authorizing automatic avoid away basic because behalf believe below benefit best between beyond body box brief business cease cessation changed changing characterized choosing circumstances civil class clear clearly closely collect combination combine commercial common compilations compiler compliance comply computers concerning concerns conditioned consequential consider considered conspicuously constantly constitutes construed contact contain containing content contents context continued contradict contrast controlled convenient conveyance copyleft copyrightable copyrighted correction counterclaim countries course court courts covenant criterion cross cure customer danger date december decide declining deemed defective defenses defined definitions denied denominated deny denying deprive designated detail determining develop development devices differ differently direction directions disclaim disclaiming displayed distinguishing distributed distributing documented doubtful dwelling dynamically effect effected effective efforts electronic employer enable enables end entered entirely erroneously event ever every exact excluded excluding exclusion exclusive excuse execute executing exercising expected expects explains expressed expressly extended extensions f fails failure fair family fashion favor feature flow force format forms found freedoms fsf fulfilling full functioning fundamentally generally generate gives greatest guarantee gui had hereafter hope hosts household html hypothetical idea identifiable implement import importing inability inaccurate inc incidental inclusion incompatible incorporating incorporation indemnification independent indicate indicating industrial inform initiate inside instead intended intention interfered interpretation interpreter intimate invalidate irrevocable item itself june kernel key keys knowledge larger lawsuit lesser lgpl licensee licensing likewise link linked linking litigation loss losses machine mail maintain makes manufacturer march marks masks materially meaning measure meet meets menu mere merging met methods might misrepresentation model moreover nature neither next noncommercially nor normal notifies notify obligate obligated occasionally occurring offered official operate operated operating options origin out outside own owned packaged packaging paper paragraphs pass password pattern payment peers performance permits perpetuity pertinent physically pieces please plus pointer possesses possibility possible power practical preamble precise precisely preferred present presents preservation prevented primarily private procedures procuring programmer programming prohibits prominently propagating property protocols prove provisionally publicity pursuant qualify quality read readable readily reading ready reason receipt receiving recognized referring refrain regard regenerate relationship remain removal render rendered repair represent requires resolved responsible restrict restricting result results retains return reviewing risk rom rules runs safest sake saying school scope scripts secondarily sell semiconductor separable separate serves servicing shared short sign significant simultaneously sold sole spare speak specify spirit stand standards start starts state states status steps storage subdividing subject sublicenses sublicensing subroutine substantial sue suffice supports survive sustained systematic take tangible tells terminal terminated terminates things though threatened tools trade trademark trademarks transfer transferred transferring treated treaty two typical unacceptable unlimited unnecessary unpacking until updates view violates visible void volume waive waiver was welcome well were whatever whom whose why widely window wipo working worldwide years yourself",
        2: "13 5 accept acquired after against applies arrange assumptions attach authorizes being both carry case cases cause choose claim combined comes commitment communication computer consistent contains continue contractual conveys cost coverage customarily days definition directly discriminatory display displays domains downstream durable e earlier effectively embodied enforce enforcing ensure entity even everyone exceptions exclusively explicitly express extend facilities file finally find first fitness fixed forbid future giving gratis having holders implementation imposed individual individuals infringe interchange interest kind kinds know knowingly language laws least liable licensees like limit limitation limited line list local made marked merchantability mode modifies modifying names necessary normally nothing notwithstanding number numbered occurs offering operation order organization organizations original our paragraph performing personal portion practice prevent previous produce prohibit prohibiting protecting protection proxy publicly publish released relevant relicensing relying remove respect responsibilities restrictions revised sale selling service share similar single specified specifies statement subprograms subsection substantially supplement surrender terminate termination three thus too transmission type useful w warranties ways wish within writing year",
        3: "11 15 16 2007 6 above accompanied activities added affero aggregate agreement allowed arrangement called cannot commands compilation consequence conveyed could country damages data details developers disclaimer document equivalent essential executable follow following given governed grants impose included infringed infringement installed intact interaction interfaces keep libraries library licensed limiting long manner measures modifications name needed option output permit possession predecessor prior problems products prominent proprietary protect provision published purposes receives redistribute refers reinstated remains restriction resulting right royalty running satisfy sections see separately solely specific specifically standard support sure technological there unmodified uses verbatim want whole www",
        4: "10 4 7 acceptance accord add anyone anything author automatically certain claims connection consumer copying d different entire except exercise fee files get https implied includes install installation interactive licensors obligations org others peer permanently permissive price propagation required requiring special stating term than then therefore through time using valid what written",
        5: "along change circumvention component distribute distribution example grant into later major most need permitted place provide purpose recipient regardless require requirement requirements same server shall stated system unless violation where whether",
        6: "1 2 3 access based been control designed extent foundation give how however include medium modification otherwise parts patents physical programs reasonable should show their they",
        7: "also authors b gpl granted interface liability more new one recipients some transaction way we when without would",
        8: "appropriate at c charge freedom further including information making network notice offer only parties receive received run them who will",
        9: "applicable available either has licenses non propagate third users",
        10: "contributor each holder its law part particular permission permissions these",
        11: "form legal notices so",
        12: "modify party s used works",
        13: "can does material modified provided",
        14: "additional apply conditions copies have make must those versions",
        15: "conveying section user warranty",
        16: "but do",
        17: "no",
        18: "means",
        19: "rights",
        20: "free",
        21: "all object product such which",
        22: "gnu",
        23: "corresponding general patent",
        24: "use",
        25: "copy public version",
        26: "an convey",
        27: "software",
        28: "are",
        29: "be from",
        30: "copyright other",
        31: "may on",
        32: "terms",
        34: "code your",
        38: "as",
        41: "covered",
        42: "source",
        43: "by",
        44: "under",
        45: "with",
        49: "if",
        50: "any",
        51: "not",
        52: "it program",
        70: "is",
        81: "in",
        86: "for this",
        91: "that",
        97: "work",
        98: "and",
        102: "license",
        128: "you",
        151: "or",
        184: "a",
        192: "to",
        221: "of",
        345: "the",
    },
    "LGPL-2.1": {
        1: "0 10 11 12 13 14 15 16 1990 1991 3 4 5 7 8 9 able about absence acceptance accessors accompanies accompanying achieve actions activities addition address addressed advantage advantages advised affected after aggregation agreed allegation alternatively although anything appeared appropriate appropriately april argument arising associated assume attempt attention authorized authors away balance becomes believed better between binary brief bring call carefully carry cases changed changing choose circumstance claim close collection collective combine company compatible compelled competing compilation compiled compiler component components computer concerns consequential considered conspicuously constant constitute contact contradict contradiction contradicts contrast contributions conveniently convey correction could counts creates customarily customer date de debugging decision defective definition deny depends derivatives detail details develop developers differ difference different directing disadvantages disclaims displays distinguishing distributor distributors document donor during e effort electronic employer encourage end enforcing engineering especially ever every exceptions exchange excluded excluding exclusion excuse execution existence explaining explanations explicit expressed expressly extend extent fact facto failure faith falls february finally find fits follow forbid former forming found frequent frob further gain gave generally generous geographical gives goals good gpl granted grants gratis greater greatest guarantee guided hacker happen he header held hence here hereby herein hereinafter holders hope idea identifiable implemented imposed inability inaccurate incidental included incompatible incorporate incorporates indicate indirectly induce information informed infringe infringement inline insist installation installs intact integrity interchange interest interfaces introduced invalid invoked irreversible isolation issues james job judgment keep kernel kind knobs language large latter lax layouts legal length liable licensees licensor limiting lines linux little loss losses macros mail major material meaningful meet mere method might modules names necessarily needed newer nothing numerical obtained obtaining occasions once operates opt optional others out output over own packages paper parameters parts pay performance performing performs permissions permitting pertinent physical pieces placed places pointer pose possibility practices preamble precise precisely preferred prepared preserving president price programmer prohibited promoting properly property proprietary protecting protection protective prove quality quite random range rare reasonably receives recipient recommend recompile recompiling reference referring refrain released reliance remain remains rendered repair reproducing reputation requirements requires responsibilities responsible rest restrict restrictive reuse reverse revised risk root royalty running runs safest sample satisfies say saying school scripts see sent service servicing sharing she show sign signature signed significant similar simultaneously since single sole someone sometimes speak speaking specially specifies spirit standard start stated states statically stating status step storage straightforwardly strategy structure subject subsequent successor suggest surrender sustained take ten term terminate terminated themselves think thoroughly threat three threshold tool transferring translate translated translation tweaking typically understood unenforceable unrestricted up utility valid validity variant verify very vice void volume warranties was way were whereas wherewithal wide widely widest willing wrote year years yoyodyne",
        2: "02110 1301 1999 51 accept act add agreement allowed alter among another applicable ask attach automatically been being below body boston both called cause choice circumstances claims clear combination compliance compute consistent contents contest control coon copyrighted corresponding cost court criteria decide defined definitions derived directly disclaimer distributing effectively else enables ensure equivalent event everyone except exception exercise fall fifth first fitness floor following franklin how impose intent interface know least legally licensed licensee line long ma mechanism merchantability modifying name necessary normally obligations operate outside passed permits possible present problems produce provide provides publish reason redistribution refers regardless relink requirement restricted right roots satisfy share shared side small specify street sublicense subsection suitable supplied their though together too ty uncombined unless usa useful versions whatever where whose would",
        3: "2.1 along already b because changes consequence countries d damages designed entire entirely fee full get given implied inc include independent instead later limitation limited machine making many medium most need offering order our party patents people permit plus portions prominent published rather readable received refer required run scope separate some specified square still supply table things through true users using verbatim want well write writing",
        4: "access author cannot case designated even executables facilities facility functions intended itself less licenses materials modifications offer one operating option protect receive recipients redistribute restrictions special sure third thus time two written",
        5: "accompany applies c charge combined containing contains copying example file files give holder however including into law link linking means modification more number original otherwise particular patent permission permitted place portion should there those what wish without",
        6: "6 certain complete covered form function made new non notice notices only part purpose them therefore used works",
        7: "apply at change data either has linked no parties provided s same than who whole",
        8: "1 application but sections then they when whether",
        9: "above copies distributed each foundation freedom libraries programs system",
        10: "also does have its make modify object user warranty will",
        11: "2 conditions do executable modified ordinary rights which",
        12: "an derivative program",
        13: "can section uses",
        14: "copyright",
        15: "lesser so source your",
        16: "all based",
        17: "distribution from gnu such we",
        18: "are",
        19: "these",
        21: "may",
        23: "code distribute must",
        24: "under",
        25: "version",
        26: "other terms",
        27: "general use",
        29: "be public",
        30: "as copy on",
        35: "software",
        36: "free",
        39: "any by",
        40: "if",
        41: "not",
        42: "with",
        45: "in",
        50: "it",
        53: "for",
        58: "work",
        67: "this",
        76: "license",
        79: "is that",
        80: "or",
        88: "you",
        91: "and",
        124: "a",
        140: "library to",
        160: "of",
        349: "the",
    },
    "LGPL-3.0": {
        1: "2 29 5 acceptance accessors accompanying address allowed already among applicable applications applies apply argument at authorization being bound called can certain changing class combining compatible computer concerns considered contained conveyed debugging decide deemed defining definitions detail differ directing displays distinguishing distribute during e effectively effort either engineering ensure event ever everyone exception execute execution explaining extent faith fewer file files find fsf functions future given good governed have herein https inc include including incorporate incorporated incorporates incorporating inline install invoked isolation june layouts length limited lines listed macros made make makes meaningful mode modification modify necessary needed none numbered numerical operate operates org parameters particular passed performs permanent permit permitted place problems produce programs properly publish purpose recombine recombining reference relink relinking remains reproducing required restrict reverse run sections shall shared similar single small specify spirit statement still structure subclass supplemented supplied supply taken templates ten then these using utility verbatim was well whatever when where whether without works would",
        2: "2007 also below both c choose conditions copies defined does excluding function header later libraries linking manner means mechanism modifications must notices number one only otherwise permissions portions present produced proxy revised s same side specified specifies system than together uncombined uses which will",
        3: "0 1 additional be choice conveying copyright d facilities form give installation interface its material minimal new option part prominent provide published received suitable time used user",
        4: "4 6 accompany data document each facility foundation free from notice other provided refers software your",
        5: "b based but covered do following information linked section versions",
        6: "are convey object such use",
        7: "modified on",
        8: "3 any as it source terms",
        9: "an corresponding lesser may not",
        10: "copy gpl if under",
        11: "code general",
        12: "public",
        13: "in",
        14: "application or",
        15: "for this",
        16: "with",
        17: "by",
        18: "is",
        20: "you",
        21: "combined gnu",
        22: "to",
        24: "work",
        25: "license",
        26: "that",
        27: "version",
        30: "and",
        34: "library",
        44: "a",
        60: "of",
        114: "the",
    },
    "MPL-2.0": {
        1: "1 1.10 1.11 1.12 1.13 1.14 1.2 1.3 1.4 1.5 1.6 1.7 1.8 1.9 10 10.1 10.4 2.2 2.3 2.4 2.5 2.6 2.7 3 3.0 3.5 30 4 5 5.3 50 6 60 7 8 9 ability able absence absolutely accurate actions add addition additionally affect affero agree agreement agreements alleging allow alone anyone apparatus application asserting assume authorized automatically back believes beneficial bring brought business c case cause caused character circumstances clear combines come commercial common complete computer concerning conflict constitutes construe construed contained contains contents contribute contributes contributors controlled controls correction courts creates dealing death declaratory defective defects defendant defined definition definitions deletion describe desirable detailed different differs direction directly directory display distinguishing distributed distributing distributions doctrines document drafter earlier effect end enforceable entire entities equivalents essential even event every exclusive exercising explicitly exploit expressed factual fail fails failure fee fifty files finally fit following foundation further given goodwill held hereof http i ii impossible inability inaccuracies included includes incurred indemnify indirectly informed infringement infringements infringes infringing initiate injury intellectual intended into judgment judicial jurisdictions kind known language later laws lesser liable licensing likely location logos look loss losses lost maintains makes malfunction management manner marks material matter merchantable method miscellaneous modification moreover name note nothing notifies notify notwithstanding number obligation obligations offered offering option order ordinary org original originally others outstanding own owns percent perform performance permits personal place placed portions possibility power preferred prevent principal process profits prohibited prohibits property prove provides provisionally provisions publish published purpose purposes put quality receipt reference references reformed relating relevant remedy removed rename repair representation reproduce required resellers responsibilities restrict resulting results risk royalty scope see sell selling separate service servicing shares should skill special specific statutory stoppage sublicense subsequently substance sufficient sufficiently survive terminates text their theory thereof third those timely tort trademark trademarks understand unenforceable unless unmodified until user using validly want warranties who wide within world",
        2: "1.1 10.2 10.3 2 3.2 5.1 5.2 after applicable apply attempt been behalf but charge choice choose claim compliant consequential control conveyed cost counter creation cross date days description direct disclaimers distributes distributors do does due effective excluding exclusion first free having hereby how however implied import incidental include indirect individual inform infringed limit making maximum modify mpl negligence ongoing permitted provision received reinstated remove represents requirements result right sale sections subject terminate time transfer used v was where would",
        3: "3.1 3.3 3.4 above against also attached available become can combination conditions contract copy copyright described disclaimer fair general gnu indemnity initial jurisdiction law licensable modified necessary obtain offer ownership part possible prior reasonable respect so statute subsequent support they whether will",
        4: "alter at basis compliance governed legal limitations litigation made make more one only otherwise party provided recipient regulation some steward termination",
        5: "2.0 additional are contribution create damages exhibit has mozilla new non recipients than then which without",
        6: "2.1 comply distribution each either entity extent grant grants have incompatible larger modifications notices particular public use versions",
        7: "all an except executable file including it",
        8: "claims contributions limitation no on other s warranty",
        9: "distribute from granted liability must your",
        10: "patent shall",
        11: "notice section work",
        12: "as b secondary",
        13: "licenses",
        14: "its rights",
        16: "may",
        17: "if not version",
        18: "be means",
        20: "source terms",
        21: "code",
        22: "for with",
        23: "is",
        26: "by that",
        29: "form",
        30: "in",
        32: "such",
        35: "contributor under",
        36: "and covered",
        39: "software",
        44: "any",
        49: "this",
        50: "you",
        55: "a",
        62: "to",
        67: "or",
        69: "license",
        115: "of",
        130: "the",
    },
    "MIT": {
        1: "above action all an arising as associated authors but c charge claim conditions connection contract damages deal dealings distribute do documentation event express files fitness following free from furnished granted hereby holders implied included kind liability liable license limitation limited merchantability merge mit modify no noninfringement not obtaining otherwise out particular permit person persons portions provided publish purpose restriction rights sell so subject sublicense substantial tort warranties warranty whether whom with",
        2: "a be copies copy for including notice other permission shall this use",
        3: "any copyright without",
        4: "is",
        5: "and",
        6: "in",
        8: "of to",
        9: "or software",
        14: "the",
    },
}

TERMS = {name: {term: n for n, listed in counts.items() for term in listed.split()} for name, counts in _LISTED.items()}
