"""Curated subject terms with weights: general vocabulary of twelve subjects in English, French and Creole.

A term of weight 3 settles the subject of a sentence alone, one of weight 2 nearly so, one of weight 1 only helps.
Longer terms win over the shorter ones they contain. Terms are written without accents, in lower case; a trailing ``*`` also
takes any further letters. Only words and established terms of a subject stand here, no pieces of sentences: phrases that a
corpus uses of a subject beyond these are learned from its labelled rows (:func:`hemispark.llm.subjects.learn_terms`).
"""

TERMS: dict[str, dict[int, str]] = {
    "health": {
        3: "health; healthcare; hospital*; clinic*; doctor; doctors; physician*; surgeon*; surgery; surgical; nurse; nurses; nursing; midwife; midwives; ambulance*; paramedic*; vaccin*; immunis*; dialysis; diabet*; cancer*; tumour*; patient; patients; medical; medicine; medicines;"
        " pharmac*; dispensary; dispensaries; insulin; antibiotic*; dengue; malaria; tetanus; measles; tuberculosis; influenza; covid*; epidemic*; pandemic*; infection*; virus*; maternity; antenatal; obstetric*; paediatric*; outpatient*; inpatient*; blood bank*; blood donor*; organ donor*; mental health; mental-health; psychiatr*; dentist*; dental;"
        " midwifery; stretcher*; matron*; bedside; x-ray*; radiolog*; scanner*; cardiac; stroke; obesity; cholesterol; hygiene; sanitary; palliative; hospice*; public health; waiting list for surgery; intensive care; emergency ward*; operating theatre*; primary care; first aid;"
        " hopita*; medecin*; infirmier*; infirmiere*; chirurgi*; sante; malade; malades; maladie*; medicament*; ordonnance medicale; vaccination; dialyse; depistage*; maternite*; urgences; soins; sage-femme*; don de sang; dons de sang; cancerolog*; diabete; salle d'operation; sante publique;"
        " lopital; dokter; infirmie*; malad; maladi*; lasante; medsinn; medikaman; vaksin*; dializ*; diabet; dispanser; famasi; lanbilans; loperasion; swen; disan; lafiev",
        1: "ward; wards",
        2: "symptom*; treatment; therapy; therapist*; diagnos*; jab; jabs; fever*; fracture*; wound*; injection*; dose; doses; prescription*; counselling; nutrition; kidney*; pregnan*; syringe*; pharmacy; sick; illness*; disease*; fievre; pansement*; gripp; pikir",
    },
    "education": {
        3: "education*; school; schools; schooling; pupil*; student*; teacher*; teaching; classroom*; class size*; textbook*; literacy; numeracy; curriculum; curricula; syllabus*; examination*; exam; exams; tuition; university; universities; college; colleges; headmaster*; headmistress*; head teacher*; headteacher*; vocational;"
        " truancy; pre-primary; preschool*; kindergarten*; nursery school*; primary school*; secondary school*; special needs; scholarship*; sixth form; lecturer*; professor*; apprentice*; diploma*; undergraduate*; polytechnic*; homework; blackboard*; school uniform*; uniform grant*; school meal*; school bus*; school buses; school caretaker*; inspectorate of schools; university scholarship*;"
        " science stream*; medical student*; reading lesson*; lesson*; school leaver*; dropout*; ecole*; eleve; eleves; enseign*; professeur*; instituteur*; manuel scolaire; manuels scolaires; scolaire*; scolarite; maternelle*; college*; lycee*; universit*; etudiant*; bourse d'etudes; bourses d'etudes; bourses universitaires; programme scolaire; examen*; frais d'examen; rentree; alphabetisation;"
        " formation professionnelle; directeur de college; directeurs de college; lekol*; kolez*; profeser*; zelev; legzame*; inivesite; liniversite; edikasion; preprimer; klas; bours liniversite; aprann; formasion",
        2: "classe; classes; class; learners; marking; infants; pedagog*; graduate*; campus; literac*; lecture*; chalk; bell; devwar; kaye; cahier*",
    },
    "finance": {
        3: "tax; taxes; taxation; taxpayer relief; taxable; tax arrears; tax relief; value-added tax; vat; income tax; corporate tax; excise*; stamp duty; customs duty; customs duties; customs revenue; budget deficit; fiscal*; monetary; deficit*; surplus; exchange rate*; credit rating*; inflation*; public debt; sovereign debt; national debt; debt; debts; bond issue*; government bond*; treasury; treasury bill*;"
        " sovereign guarantee*; dividend*; consolidated fund; supplementary estimates; contingency fund; contingency vote; central bank*; recurrent expenditure; capital expenditure; foreign investment*; foreign exchange; loan repayment*; borrowing; pension; pensions; pensioner*; pension fund*; interest rate*; balance of payments; gross domestic product; stock exchange; insolvenc*; bankrupt*; money laundering; subsid*; revenue leakage*; currency; rupee depreciation; levy; levies;"
        " impot; impots; fiscalite; taxe; taxes; dette publique; dette; deficit budgetaire; inflation; taux de change; taux d'interet; arrieres d'impot; depenses courantes; recettes; recettes douanieres; droits de douane; banque centrale; obligation d'etat; obligations d'etat; tresor public; emprunt*; retraites; pension*; dividende*; finances; monetaire;"
        " bidze; tax; det; det piblik; defisi; lanflasion; labank; labank santral; ladwann; revni; pansion; lamone; lentere; finans; lasiz",
        2: "borrow*; rupee; rupees; bank; banks; banking; loan; loans; creditor*; lender*; repay*; revenue; revenues; expenditure; estimates of expenditure; auditor*; treasurer; roupi; prete; larzan",
    },
    "agriculture": {
        3: "agricultur*; agronom*; farm; farms; farmer*; farming; crop; crops; harvest*; livestock; cattle; poultry; dairy; goat; goats; sheep; pigs; piggery; beekeep*; apiar*; fertilis*; pesticide*; herbicide*; weed killer*; irrigation; irrigated; seed; seeds; seedling*; soil; soils; orchard*; pineapple*; vegetable*; onion*; potato*; tomato*; banana*; maize; wheat; rice field*; sugar cane; sugar-cane; cane field*;"
        " cane; tea estate*; plantation*; planter*; plough*; sowing; fallow; greenhouse*; fodder; pasture*; grazing; abattoir*; slaughterhouse*; milk collection; milk; crop insurance; fruit fly; fruit-fly; locust*; crushing season; growers; vegetable growers; hatchery; breeder*; veterinar*; tractor*; compost heap; drip irrigation; drip lines; irrigation canal*; food crop*;"
        " ferme; fermes; fermier*; agricole*; agriculteur*; planteur*; canne; canne a sucre; engrais; semence*; semis; recolte*; moisson*; betail; elevage*; eleveur*; lait; legume*; ananas; patate*; verger*; terres en friche; friche*; irrigation; canaux d'irrigation; pesticides; assurance des recoltes; abattoir; serre*; apicult*;"
        " plantasion; planter*; kann; langre; semans; rekolt*; legim; pomdeter; zwayon; eleveri; eleveir; bef; kabri; poul; dile; ananas; karo; irigasion; pestisid; lagrikiltir; later kiltiv",
        2: "furrow*; stalk*; cyclone-damaged crop*; barn*; weed; weeds; growers'; herd*; mill; mills; paddock*; yield; yields; karo kann; laferm; disik",
    },
    "transport": {
        3: "transport*; bus; buses; coach terminus; bus operator*; bus stop*; bus lane*; bus shelter*; bus fare*; tram; trams; tramway*; ferry; ferries; airport*; airline*; runway*; landing slot*; harbour; port authority; level crossing*; pedestrian crossing*; zebra crossing*; pothole*; road; roads; roadworks; road safety; road casualt*; roundabout*; traffic*; congestion; traffic jam*; speed camera*; speed limit*;"
        " taxi; taxis; driving licen*; driver's licence; motorcycl*; helmet*; lorry; lorries; truck; trucks; axle load*; axle*; parking*; car park*; toll; tolls; toll bridge*; railway*; rail; light rail; light-rail; train station*; rush-hour; rush hour; bypass; motorway*; highway*; flyover*; commuter*; vehicle*; passenger*; bicycle lane*; cycle lane*; street lighting; pavement*; freight; cargo handling; shipping line*; aviation; terminus; bend in the road;"
        " route; routes; autobus; bus scolaire; metro; metro leger; tramway; embouteillage*; circulation routiere; passage pieton; passages pietons; permis de conduire; taxi; patentes de taxi; radar*; rocade*; rond-point*; peage*; pont a peage; aeroport*; bac du port; traversier; voirie; autoroute*; parking; chemin de fer; passager*; transports;"
        " bis; otobis; tren; tren leze; bato ferri; ferri; loto; motosiklet; lari; larout; semin; lanbouteyaz; permi kondwir; pasaz pieton; ayropor; taxi; sofer; transpor; ronpwin",
        2: "driver; drivers; overtak*; braked; brakes; fare; fares; pedestrian*; cyclist lanes; wheel*; bridge; apron; lane; lanes; crossing; crossings; shelter; queue of cars",
    },
    "law": {
        3: "court; courts; court of appeal; supreme court; tribunal*; judge; judges; judiciary; judicial; magistra*; bail; released on parole; parole board*; penal; penal code; criminal code; sentencing; custodial; hearsay; affidavit*; plea bargain*; forensic*; contempt of court; prison; prisons; prisoner*; jail; juvenile offender*; offender*; remand*; witness protection; legal aid; legal; litigation; lawsuit*; lawyer*; barrister*; solicitor*; arrest*; arrest warrant*; search warrant*;"
        " custody; police custody; custody record*; bar examination*; court registry; registrar of the court; jury; juror*; under oath; defendant*; plaintiff*; accused person; prosecut*; acquit*; convict*; appeal court; injunction*; extradition; probation; homicide; burglar*; larceny; evidence act; notary; notaries; law society; rule of law; constitutional;"
        " tribunal; tribunaux; juge; juges; cour supreme; cour d'appel; magistrat*; magistrature; avocat*; avoue*; notaire*; code penal; procedure penale; caution; liberation conditionnelle; detenu*; prison*; carceral*; aide juridictionnelle; preuve medico-legale; protection des temoins; temoin; temoins; mandat d'arret; mandats d'arret; delinquant*; mineurs delinquants; justice; plainte; poursuites penales; huissier*;"
        " lakour; lalwa; ziz; mazistra; avoka; avwe; kod penal; prizon*; prizonie; kosion; temwin; manda; zistis; tribinal; kriminel; lapolis",
        2: "evidence; counsel; police; charge; charges; charged; oath; witness; witnesses; eviction proceedings; verdict*; behind bars; trial; trials; sentence; sentences; statute*; dock; exhibit; exhibits; enquet lapolis; jugement*",
    },
    "environment": {
        3: "environment*; ecolog*; ecosystem*; biodivers*; conservation area*; nature reserve*; coral bleaching; coral; corals; reef; reefs; mangrove*; wetland*; lagoon pollution; erosion; beach erosion; dune; dunes; turtle*; endangered; invasive; species; wildlife; fauna; flora; forest; forests; forestry; reforest*; deforest*; river pollution; pollution; polluted; polluter*; plastic waste; plastic bag*; waste; recycl*; landfill*; compost; composting; litter; littering; fly-tipping; dumping;"
        " sewage; sewage outfall*; effluent*; oil spill*; oil-spill*; air quality; air-quality; ozone; noise nuisance; noise pollution; coastal; coastal setback*; coastline; shoreline; climate change; greenhouse gas*; carbon emission*; refuse; rubbish; heron*; seabird*; native palm*; bats; sea level;"
        " environnement*; ecologi*; biodiversite; corail; coraux; blanchissement des coraux; recif*; mangrove*; zone humide; zones humides; especes; especes envahissantes; erosion des plages; pollution; pollution des rivieres; dechet*; dechets plastiques; recyclage; decharge*; centre de tri; reboisement; foret; forets; tortue*; marais; ordures; qualite de l'air; nuisances sonores; maree noire; littoral;"
        " lanvironnman; lanatir; koray; resif; laplaz; larivier; marekaz; mang; lafore; rezerv lafore; polision; pollue; salte; salte plastik; plastik; depotwar; desarz; torti",
        2: "beach; beaches; ravine*; tide; tides; lagoon; smoke; tyres; nuisance; green spaces; algae; river; rivers; plages; rivieres; lagon; lamer; zwazo; pwason mor",
    },
    "energy": {
        3: "energy; electric; electricity; electrical; electrif*; power cut*; power outage*; power station*; power plant*; power grid; blackout*; load shedding; turbine*; wind farm*; wind power; hydroelectric*; pylon*; substation*; solar; photovoltaic*; battery storage; batteries; diesel generator*; generators; fuel oil; heavy fuel oil; fuel price*; fuel; petrol*; diesel; gas terminal*; liquefied gas; natural gas; gas cylinder*; gas cargo*; kilowatt*; megawatt*; smart meter*;"
        " electricity meter*; meter tariff*; tariff for electricity; transmission loss*; transmission line*; peak demand; renewable*; rooftop generation; bagasse; boiler*; biomass; geothermal; undersea cable*; power cable*; charcoal; kerosene; energy efficiency; nuclear;"
        " energie*; electricite; electrique*; courant; coupure de courant; coupures de courant; panneau solaire; panneaux solaires; solaire*; eolien*; centrale electrique; centrales electriques; centrale thermique; centrale a bagasse; bagasse; compteur*; tarifs du compteur; carburant*; essence; gaz; terminal gazier; reseau electrique; stockage par batterie; batterie*; fioul; chaudiere*;"
        " lenerzi; kouran; koupir kouran; elektrisite; elektrik; soler; pano soler; eolienn; batri; bagas; santral; fioul; lesans; pri lesans; konter; gaz",
        2: "lamp; lamps; candle*; fridge*; in the dark; meter; meters; generator; bills for power; grid; volt*; cable; labouzi; lanp",
    },
    "sport": {
        3: "sport; sports; sporting; football*; soccer; athletic*; athlete*; sprint*; swimming; swimmer*; swimming pool*; volleyball*; basketball; handball; rugby; cricket; tennis; badminton; boxing; boxer*; judo; karate; wrestl*; weightlift*; gymnast*; cycling; cyclist*; marathon*; relay squad*; relay team*; stadium*; stadia; goalkeeper*; referee*; umpire*; league; leagues; league fixture*; gymnasium*; medal; medals; medallist*; olympic*; paralympic*; national squad*; national team*; squad; squads;"
        " tournament*; school tournament*; championship*; world cup; doping; anti-doping; floodlight*; island games; playing field*; sports scholarship*; coach; coaches; athletics coach*; swimming coach*; runner; runners; goal nets; captain of the team; podium*; scorer*; track and field;"
        " football; footballeur*; athletisme; natation; piscine*; volley; volleyball; boxe; boxeur*; cyclisme; cycliste*; stade*; gardien de but; gardiens de but; arbitre*; gymnase*; medaille*; tournoi*; tournoi scolaire; tournois scolaires; championnat*; selection nationale; equipe nationale; antidopage; dopage; entraineur*; sportif*; sportive*; coureur*; lutte; federation de boxe;"
        " spor; foutborl; volei; natasion; pisinn; boks; bokser; koureur; koureur velo; stad; gardien; arbit; larbit; meday; tournwa; ekip nasional; ekip nasyonal; antrener; lantrener; atlet; lig; sanpiona; zwer",
        2: "match; matches; team; teams; club; clubs; games; heat; heats; pitch; fixture; fixtures; metres; barefoot; jersey*; net; nets; trophy; trophies; scored; klib; ekip; fitness",
    },
    "science": {
        3: "scientific; scientist*; science laborator*; research; researcher*; research grant*; research vessel*; doctoral; doctorate*; genome*; genomic*; genetic*; microbiolog*; microscop*; laboratory; laboratories; seismolog*; seismic; telescope*; astronom*; observatory; spectromet*; physics; physicist*; chemist; chemists; chemistry; biolog*; plankton*; rainfall model*; climate model*; isotope*; carbon isotope*; volcanic rock*; volcanolog*; geolog*; rock core*; ocean temperature*; oceanograph*; herbarium*;"
        " peer review; peer-review*; innovation council; tide gauge*; experiment*; field experiment*; hypothesis; hypotheses; thesis; theses; instrument calibration; lava; sensor; sensors; satellite*; satellite imagery; botanist*; zoolog*; entomolog*; paleontolog*; nanotechnolog*; statistician*;"
        " scientifique*; science; sciences; recherche scientifique; chercheur*; chercheuse*; bourses de recherche; laboratoire*; microscope*; telescope*; genome; genetique; sismolog*; sismique; station sismologique; satellite; imagerie satellite; herbier*; doctorant*; isotope*; oceanograph*; echantillon*; revue par les pairs; modelisation; carottes; plancton; experience scientifique;"
        " siantifik; lasians; resers; serser; laboratwar; mikroskop; mikrob; teleskop; satelit; zimaz satelit; sismik; stasion sismik; esantiyon; herbie; zenetik; zenom",
        2: "sample; samples; readings; gauge; gauges; measurement*; dataset*; instruments; specimen*; etid; crater*; core; cores; fossil*",
    },
    "software": {
        3: "software*; database*; server; servers; server outage*; cloud hosting; cloud; hosting contract*; chatbot*; broadband; cybersecurity; cyber security; cyber-security; cyber*; data centre*; data center*; firewall*; mainframe*; legacy system*; mobile app; mobile apps; mobile application*; online form*; online portal*; web portal*; website*; open data; password*; passcode*; phishing; programmer*; software developer*; coding; source code; algorithm*; system backup*; backup*; digital; digitis*; digital identity; e-government; help desk*; helpdesk;"
        " login*; log-in; payroll application*; encryption; encrypted; computer*; computing; informatics; information technology; operating system*; bug fix*; user interface; screen froze; malware; ransomware; hacker*; hacking; patches; interoperab*; internet; artificial intelligence; machine learning; laptop*; tablet computer*; e-mail server*;"
        " logiciel*; informatique*; base de donnees; bases de donnees; serveur*; panne de serveur; pannes de serveur; hebergement; nuage; portail numerique; portails numeriques; numerique*; application mobile; applications mobiles; sauvegarde*; mot de passe; mots de passe; cybersecurite; securite informatique; ordinateur*; programmeur*; internet; haut debit; pare-feu; hameconnage; code source;"
        " lozisiel; lordinater; serveur; server; baz done; portay; portay internet; internet; aplikasion; aplikasion mobil; sovgard; modpas; dizital; lidantite dizital; pwogramer; programer; sekirite lordinater; sit web",
        2: "application; screen; screens; online; upload*; download*; typed; users; bugs; bug; release; interface; mails; web; vendor lock*; migration; outage*; lekran; site web",
    },
    "housing": {
        3: "housing; social housing; housing estate*; tenant*; tenancy; tenancies; eviction*; evict*; rent; rents; rental*; rent arrears; landlord*; landlady; mortgage*; home loan*; home owner*; homeowner*; homeless*; first-time buyer*; council flat*; council house*; flat; flats; apartment*; waiting list for flats; stairwell*; asbestos; roof; roofs; leaking roof*; damp; bedroom*; prefabricated; dwelling*; squatter*; slum*; shant*; land lease*; title deed*; residential; residential plot*; building permit*; building-permit*; key handover*; sewer connection*;"
        " housing company; housing corporation; low-cost house*; new houses; houses; house building; affordable home*; cracked wall*; overcrowded hous*; shelter for the homeless; plumbing; housing unit*;"
        " logement*; logements sociaux; locataire*; loyer*; loyers impayes; proprietaire*; expulsion*; pret immobilier; prets immobiliers; immobilier*; appartement*; maison; maisons; maisons neuves; toit; toits; toiture*; amiante; squatteur*; bidonville*; parcelle*; parcelles residentielles; permis de construire; permis de batir; hlm; titre de propriete; liste d'attente pour un appartement; fissures;"
        " lozman; lakaz; lakaz sosial; lwaye; loye; lokater; proprieter; lapartman; apartman; skwater; lamiant; lamezon; twa; permi batir; konstrir; terin pou konstrir; linz lakaz",
        2: "ceiling*; wall; walls; window; windows; keys; landlords'; plot; plots; estate; homes; home; shed; sheds; yard; yards; lease; leases; tile; tiles; lasam; kwin lakaz",
    },
}

#: Idioms and words of procedure whose words are no subject terms.
NO_SUBJECT = (
    "healthy debate; healthy exchange; ball is in their court; ball is in your court; ball is now in their court; long grass; long-grass; order paper; standing order*; point of order; question put; select committee; inter-ministerial committee; court case; green paper; white paper;"
    " road map; roadmap; in the same boat; back to the drawing board; drawing board; level playing field; playing field is level; tip of the iceberg; move the goalposts; goalposts; pole position; political football; food for thought; seeds of doubt; bitter pill; under the weather; cold feet;"
    " storm in a teacup; sitting on the fence; sea change; light at the end of the tunnel; the house; this house; house of; in the house; members of the house; at home and abroad; school of thought; of course; race against time; own goal; game of; in the long run; take the floor; budget speech; bank holiday;"
    " uphill road; on the road to; traffic of; courtesy; bridge the gap; through the roof; window of opportunity; green light; red light; fuel the; bell the cat; charge of; in charge; in charge of; free of charge; second reading; first reading; matches the; no match for; home truth; walls have ears; key to; team of officers; social network; network of friends;"
    " revenue office; revenue authority; lagoon authority; audit bureau; statistics office; consumer council; standards institute; planning commission; public service board; regional council; tender panel; works directorate; health and safety of this house; cost the taxpayer; cour des comptes; la maison est; ordre du jour"
)
