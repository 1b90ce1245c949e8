"""A small labelled table of URLs: what a training corpus should not hold (1) and what it may (0).

Written by hand in the manner of what a crawl meets; the sites are made up, but for well-known public ones among
the good.  The label is by what the address says of its page: adult content, gambling, pills, loans, pirated or
cracked software, link farms, doorway pages, ad and tracking servers, phishing and malware against everything else.
A line holds one site with its pages: the label, then URLs.
"""

_TABLE = """
1 https://www.royalspincasino.com/en/slots/mega-fortune http://royalspincasino.com/bonus/no-deposit-free-spins
1 https://lucky7slots.net/play/fruit-machine https://lucky7slots.net/register?aff=2231
1 http://bet-master365.com/sports/football/odds http://bet-master365.com/live-betting
1 https://www.allinpokerroom.eu/texas-holdem/tournament https://www.allinpokerroom.eu/freeroll/bonus.html
1 http://online-casino-reviews24.info/best-casino-bonus-2023 http://online-casino-reviews24.info/roulette/winning-system
1 https://vegas-jackpot-city.biz/de/spielautomaten https://vegas-jackpot-city.biz/promo/welcome-bonus
1 https://tipster-bets.co/free-tips/today https://tipster-bets.co/bookmakers/bonus
1 http://www.winbigbingo.uk.com/rooms/jackpot http://www.winbigbingo.uk.com/signup/free-credit
1 https://apuestas-deportivas-gratis.es/bono-bienvenida https://apuestas-deportivas-gratis.es/cuotas/liga
1 https://paris-sportifs-bonus.fr/cotes/ligue1 https://paris-sportifs-bonus.fr/casino-en-ligne/machines-a-sous
1 https://blackjack-winner.org/strategy/card-counting-app https://blackjack-winner.org/win-money-now
1 http://spinandwin.top/wheel-of-fortune http://spinandwin.top/slots/win-real-money
1 http://www.hotcamgirls.tv/live/blonde http://www.hotcamgirls.tv/free-chat/18plus
1 https://xxxvideotube.org/watch/milf/4421 https://xxxvideotube.org/categories/hardcore
1 https://free-porn-archive.net/videos/amateur https://free-porn-archive.net/galleries/nude/88
1 http://adultfriend-dating.com/meet-sexy-singles http://adultfriend-dating.com/profiles/hot-girls
1 https://escort-directory-milan.com/girls/anna https://escort-directory-milan.com/call-girls/price-list
1 https://sexshop-discreet.de/toys/vibrator https://sexshop-discreet.de/dessous/angebote
1 http://nudecelebs.xxx/leaked/photos http://nudecelebs.xxx/sex-tape/full
1 https://adultgames3d.com/hentai/play https://adultgames3d.com/download/uncensored
1 http://www.maturesexdates.nl/chat http://www.maturesexdates.nl/erotic/contact
1 https://x-rated-stories.net/erotica/page/3 https://x-rated-stories.net/adult/taboo
1 http://eroticmassage-finder.com/city/berlin http://eroticmassage-finder.com/adult-services
1 https://videos-x-gratuites.fr/porno/amatrice https://videos-x-gratuites.fr/sexe/direct
1 http://buy-viagra-cheap.com/order/100mg http://buy-viagra-cheap.com/generic-cialis-online
1 https://canadian-pharmacy-rx.net/no-prescription/tramadol https://canadian-pharmacy-rx.net/pills/discount
1 http://meds4less.biz/buy-xanax-without-prescription http://meds4less.biz/cheap-pills/ambien
1 https://slim-fast-keto-pills.com/lose-weight-now https://slim-fast-keto-pills.com/order-discount
1 http://enlarge-now.top/male-enhancement-pills http://enlarge-now.top/free-trial-bottle
1 https://www.cheapmedsonline.ru/cialis-20mg https://www.cheapmedsonline.ru/cart/discount-pills
1 https://steroids-shop24.com/buy-anabolic https://steroids-shop24.com/testosterone/cheap
1 http://pillole-economiche.it/viagra-generico http://pillole-economiche.it/offerta
1 https://potenzmittel-rezeptfrei.de/viagra-kaufen https://potenzmittel-rezeptfrei.de/billig
1 https://payday-loans-instant.com/apply-now https://payday-loans-instant.com/bad-credit/cash-today
1 http://quickcash-advance.us/no-credit-check http://quickcash-advance.us/fast-loan/approval
1 https://crypto-doubler.io/invest/double-bitcoin https://crypto-doubler.io/guaranteed-profit
1 https://forex-robot-profit.com/make-money-fast https://forex-robot-profit.com/free-signals/join
1 http://earn-from-home-easy.info/make-5000-a-week http://earn-from-home-easy.info/cash/secret-method
1 https://debt-relief-deals.net/free-quote https://debt-relief-deals.net/cheap-refinance
1 http://bitcoin-giveaway-now.live/claim-free-btc http://bitcoin-giveaway-now.live/win/prize
1 https://crackedsoftware4u.net/download/keygen-photoshop https://crackedsoftware4u.net/serial/activator
1 http://warez-planet.to/full-version-crack/office http://warez-planet.to/games/repack
1 https://free-movies-torrentz.cc/download/1080p https://free-movies-torrentz.cc/stream/watch-free
1 http://serialkeys.ws/windows-activation-key http://serialkeys.ws/crack/patch.exe
1 https://modapk-hack.com/unlimited-coins https://modapk-hack.com/cheats/free-gems-generator
1 http://pirate-stream-sports.live/watch-free/match http://pirate-stream-sports.live/hd-link
1 https://nulled-themes.download/wordpress/pro-free https://nulled-themes.download/plugin-crack
1 http://linkfarm-directory.info/links/submit-your-link http://linkfarm-directory.info/category/backlinks
1 https://buy-backlinks-seo.net/cheap-links/package https://buy-backlinks-seo.net/pbn/rank-fast
1 http://spam-comments-blast.com/software/auto-poster http://spam-comments-blast.com/bulk-email/list
1 https://article-spinner-farm.org/spun/7721 https://article-spinner-farm.org/content-farm/keywords
1 http://best-deals-click.info/offer?clickid=22 http://best-deals-click.info/redirect/buy-now
1 https://top10-cheap-products.site/best-cheap-mattress https://top10-cheap-products.site/review/discount
1 http://seo-spamlinks.biz/farm/page-921 http://seo-spamlinks.biz/free-traffic
1 https://cheapreplicawatches.cn/rolex-copy https://cheapreplicawatches.cn/discount/fake-bags
1 http://bulk-mailer-spam.ru/send/leads http://bulk-mailer-spam.ru/buy/emails
1 https://expired-domains-farm.com/parked?kw=insurance https://expired-domains-farm.com/links/987
1 https://ads.adnetwork-serve.com/banner?zone=41 https://ads.adnetwork-serve.com/click/track
1 http://track.clickmeter-pixel.net/pixel.gif http://track.clickmeter-pixel.net/redirect?u=99
1 https://adserver.popunder-media.com/show/popup https://adserver.popunder-media.com/adclick
1 http://tracking.affiliate-hub.biz/aff_c?offer=3 http://tracking.affiliate-hub.biz/conversion/postback
1 https://analytics-beacon.io/collect?tid=1 https://analytics-beacon.io/tracker.js
1 http://pixel.retarget-ads.com/sync http://pixel.retarget-ads.com/ad/frame
1 https://doubleadclick.net/adframe/300x250 https://doubleadclick.net/ads/iframe
1 http://adtracker-stats.ru/counter/hit http://adtracker-stats.ru/ads/js
1 https://push-notification-ads.club/subscribe https://push-notification-ads.club/ad/allow
1 http://paypa1-account-verify.com/login/secure http://paypa1-account-verify.com/update-billing
1 https://secure-bank-login-alert.top/confirm-password https://secure-bank-login-alert.top/signin/verify
1 http://appleid-unlock-support.info/verify-account http://appleid-unlock-support.info/icloud/signin
1 https://free-iphone-winner.click/claim-prize https://free-iphone-winner.click/survey/win
1 http://your-pc-infected-alert.xyz/call-support http://your-pc-infected-alert.xyz/download/cleaner.exe
1 https://flash-player-update-now.pw/setup.exe https://flash-player-update-now.pw/install/free
1 http://gift-card-generator.fun/free-codes http://gift-card-generator.fun/verify-human
1 https://bank-kunden-verifizierung.info/anmelden https://bank-kunden-verifizierung.info/tan-eingabe
1 http://replica-handbags-cheap.shop/louis-copy http://replica-handbags-cheap.shop/sale/cheap-fake
1 https://miracle-cure-diet.com/doctors-hate-this https://miracle-cure-diet.com/buy-now/free-bottle
1 http://clickbait-daily-shock.com/you-wont-believe http://clickbait-daily-shock.com/shocking/celebs
1 https://horoscope-psychic-love.biz/free-reading https://horoscope-psychic-love.biz/love-spells/order
0 https://en.wikipedia.org/wiki/Photosynthesis https://en.wikipedia.org/wiki/History_of_Portugal
0 https://de.wikipedia.org/wiki/Thermodynamik https://fr.wikipedia.org/wiki/Cath%C3%A9drale
0 https://docs.python.org/3/library/itertools.html https://docs.python.org/3/tutorial/classes.html
0 https://spark.apache.org/docs/latest/sql-programming-guide.html https://spark.apache.org/downloads.html
0 https://www.gutenberg.org/ebooks/1342 https://www.gutenberg.org/browse/authors/a
0 https://developer.mozilla.org/en-US/docs/Web/CSS/grid https://developer.mozilla.org/en-US/docs/Learn
0 https://arxiv.org/abs/1706.03762 https://arxiv.org/list/math.NT/recent
0 https://www.nasa.gov/missions/webb https://www.nasa.gov/image-of-the-day
0 https://www.riverton-gazette.com/news/local/council-approves-bridge https://www.riverton-gazette.com/sports/2021/high-school-final
0 https://northshore-herald.co.uk/opinion/letters/2019/05 https://northshore-herald.co.uk/weather/weekend-forecast
0 https://www.tagesanzeiger-nord.de/politik/landtag/haushalt-4412 https://www.tagesanzeiger-nord.de/kultur/theater
0 https://lejournal-de-provence.fr/societe/ecoles/rentree https://lejournal-de-provence.fr/meteo
0 https://diario-del-sur.es/economia/2020/exportaciones https://diario-del-sur.es/cultura/libros/resena
0 https://corriere-della-valle.it/cronaca/incidente-stradale https://corriere-della-valle.it/sport/calcio
0 https://www.midlandradio.org/programmes/morning-show https://www.midlandradio.org/news/transport
0 https://blog.hannahbakes.com/2018/sourdough-starter-guide https://blog.hannahbakes.com/recipes/lemon-tart
0 https://simplegardennotes.net/growing-tomatoes-from-seed https://simplegardennotes.net/compost/beginners
0 https://blog.trailwalker.org/2017/hiking-the-highlands https://blog.trailwalker.org/gear/boots-tested
0 https://m.familykitchen.com/dinner/chicken-stew https://m.familykitchen.com/healthy/lunch-ideas
0 https://thequietreader.com/reviews/middlemarch https://thequietreader.com/essays/on-rereading
0 https://blog.smallwoodworks.net/oak-table-build https://blog.smallwoodworks.net/tools/hand-planes
0 https://notesonmathematics.org/algebra/groups https://notesonmathematics.org/number-theory/primes
0 https://thornhill-school.sch.uk/admissions/term-dates https://thornhill-school.sch.uk/parents/newsletter
0 https://www.westbrook.edu/departments/biology/faculty https://www.westbrook.edu/library/opening-hours
0 https://cs.lakeview.edu/~jmartin/algorithms/notes.html https://cs.lakeview.edu/courses/cs101/syllabus
0 https://www.uni-hohenfels.de/fakultaeten/physik https://www.uni-hohenfels.de/studium/bewerbung
0 https://www.univ-bretagne-sud.net/recherche/laboratoires https://www.univ-bretagne-sud.net/formation/licence
0 https://universidad-del-valle.edu.co/investigacion/grupos https://universidad-del-valle.edu.co/biblioteca
0 https://openlearn-courses.org/history/industrial-revolution https://openlearn-courses.org/chemistry/unit-4
0 https://www.statistics.gov.ie/population/census-2011 https://www.statistics.gov.ie/labour/earnings
0 https://www.parliament.ie/bills/2014/energy https://www.parliament.ie/members/debates
0 https://cityofashland.us/planning/zoning-map https://cityofashland.us/services/recycling
0 https://www.gemeinde-talheim.de/rathaus/oeffnungszeiten https://www.gemeinde-talheim.de/vereine
0 https://mairie-saintmartin.fr/vie-municipale/conseil https://mairie-saintmartin.fr/demarches/etat-civil
0 https://healthinfo-trust.org/conditions/asthma https://healthinfo-trust.org/vaccines/children
0 https://www.stmaryhospital.org/patients/visiting https://www.stmaryhospital.org/departments/cardiology
0 https://nutrition-facts-lab.org/vitamins/iron https://nutrition-facts-lab.org/articles/fibre
0 https://physio-exercises.net/back-pain/stretching https://physio-exercises.net/knee
0 https://www.heritage-museum.org/collections/ceramics https://www.heritage-museum.org/exhibitions/2016/maps
0 https://nationaltheatre-archive.org/plays/hamlet-1948 https://nationaltheatre-archive.org/actors
0 https://classicalmusicguide.net/composers/brahms/symphonies https://classicalmusicguide.net/concerts
0 https://thefilmjournal.org/interviews/directors https://thefilmjournal.org/reviews/documentary
0 https://railway-history.org/lines/northern https://railway-history.org/locomotives/steam
0 https://birdwatchers-society.org/species/heron https://birdwatchers-society.org/sightings/2015
0 https://geology-of-wales.net/fieldtrips/snowdonia https://geology-of-wales.net/maps
0 https://starcharts-astronomy.org/constellations/orion https://starcharts-astronomy.org/telescopes/beginners
0 https://forum.linuxhelpers.org/viewtopic.php?t=5512 https://forum.linuxhelpers.org/wiki/grub
0 https://stackoverflow.com/questions/231767/what-does-yield-do https://stackoverflow.com/questions/tagged/sql
0 https://github.com/apache/spark/blob/master/README.md https://github.com/pandas-dev/pandas/issues/120
0 https://forum.motorcyclerestorers.net/threads/carburettor.331 https://forum.motorcyclerestorers.net/members
0 https://gardenersforum.co.uk/threads/roses-in-winter https://gardenersforum.co.uk/faq
0 https://answers.homebrewers.org/question/mash-temperature https://answers.homebrewers.org/tags/yeast
0 https://chess-openings-study.org/sicilian/najdorf https://chess-openings-study.org/endgames/rook
0 https://www.mountainweather.ch/bulletin/avalanche https://www.mountainweather.ch/stations/davos
0 https://www.hotel-seeblick.at/zimmer/doppelzimmer https://www.hotel-seeblick.at/anreise
0 https://visit-alentejo.pt/en/beaches https://visit-alentejo.pt/pt/gastronomia
0 https://www.oakfurniture-makers.co.uk/tables/dining https://www.oakfurniture-makers.co.uk/delivery
0 https://bookshop-corner.com/fiction/new-releases https://bookshop-corner.com/authors/woolf
0 https://www.camera-repairs.net/lens/cleaning https://www.camera-repairs.net/contact
0 https://bikeparts-warehouse.com/wheels/700c https://bikeparts-warehouse.com/help/returns
0 https://www.farmersmarket-hill.org/stalls https://www.farmersmarket-hill.org/recipes/autumn-soup
0 https://insurance-explained.org/home/what-is-covered https://insurance-explained.org/glossary
0 https://www.mutual-savings-bank.com/about/history https://www.mutual-savings-bank.com/branches
0 https://personalfinance-basics.org/budgeting https://personalfinance-basics.org/pensions/state
0 https://company.brightsteel.com/investors/annual-report https://company.brightsteel.com/careers/engineering
0 https://www.greenfield-architects.com/projects/town-hall https://www.greenfield-architects.com/team
0 https://support.printmaker-devices.com/manuals/x200 https://support.printmaker-devices.com/drivers
0 https://status.cloudhost.io/incidents/2022-03 https://docs.cloudhost.io/api/reference
0 https://jsonformat-spec.org/schema/draft-07 https://jsonformat-spec.org/examples
0 https://www.lawreview-quarterly.org/articles/contract https://www.lawreview-quarterly.org/archive/1998
0 https://translators-guild.org/dictionaries/latin https://translators-guild.org/events
0 https://dictionary.plainwords.org/define/threshold https://dictionary.plainwords.org/thesaurus/other
0 https://www.theothersideofhistory.com/the-thirty-years-war https://www.theothersideofhistory.com/podcast/31
0 https://sermons.stthomaschurch.org/2012/advent https://stthomaschurch.org/choir
0 https://kinderbuch-lesen.de/geschichten/fuchs https://kinderbuch-lesen.de/autoren
0 https://recettes-de-grandmere.fr/desserts/tarte https://recettes-de-grandmere.fr/soupes
0 https://poesia-moderna.es/poetas/machado https://poesia-moderna.es/antologia
0 https://animalrescue-shelter.org/adopt/dogs https://animalrescue-shelter.org/volunteer
0 https://www.swimmingclub-harbour.org/training https://www.swimmingclub-harbour.org/results/2019
0 https://localfootballleague.org/fixtures/2020 https://localfootballleague.org/teams/rovers
0 https://www.energy-transition-institute.org/publications/heat-pumps https://www.energy-transition-institute.org/staff
0 https://oceanographic-data.org/buoys/atlantic https://oceanographic-data.org/download/salinity.csv
0 https://www.patentoffice.gov.ie/search/guide https://www.patentoffice.gov.ie/forms/application
0 https://podcasts.scienceweekly.org/episodes/204 https://scienceweekly.org/transcripts/mars
0 https://photos.lighthouse-walks.net/cornwall https://lighthouse-walks.net/routes/12
"""

#: (url, label, site number): the sites are what a held-out test must not cut across.
LABELLED = [(url, int(line[0]), site) for site, line in enumerate(_TABLE.strip().split("\n")) for url in line[2:].split()]
