"""A small labelled URL table: sites that a training corpus leaves out, and ordinary ones, labelled by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.url_filter import url_parts

#: Drugs, gambling, adult and dating sites, link farms, copied goods and programs, doubtful loans.
BLOCK = """
http://buy-pills-online.test/en/12
https://www.discount-pills.test/order/3
http://canada-pharmacy.test/viagra/7
https://generic-viagra.test/en/88.html
http://www.cheap-meds.test/de/5
https://cheap-cialis.test/shop
http://m.online-bets.test/en/9
https://sport-bets.test/odds/today
http://www.bestbets.test/fr/21
https://free-casino.test/slots/55
http://casino-bonus.test/en/100?ref=a
https://m.royal-casino.test/es/3
http://poker-room.test/free/1
https://www.lottery-winner.test/claim
http://free-slots.test/en/61
https://adult-videos.test/en/17
http://www.adult-chat.test/rooms
https://m.adultfun.test/fr/8
http://xxx-movies.test/en/4
https://hot-xxx.test/gallery/10
http://porn-tube.test/watch/77
https://sexy-dating.test/en/13
http://adult-dating.test/de/6.html
https://escort-city.test/list
http://spam-links.test/en/30
https://www.spamhub.test/post/2
http://link-farm.test/en/45
https://seo-farm.test/es/11
http://content-farm.test/en/9.html
https://backlinks-cheap.test/buy
http://free-followers.test/get
https://replica-watches.test/en/15
http://cheap-handbags.test/outlet
https://free-torrents.test/download/6
http://warez-crack.test/keygen/5
https://payday-loans.test/apply
http://fast-cash-loans.test/en/2
https://free-iphone-winner.test/claim/1
http://miracle-diet-pills.test/fr/19
https://bitcoin-doubler.test/en/7
http://pills-direct.test/en/41
https://pills4you.test/fr/3
http://www.diet-pills.test/es/12
https://bets-and-odds.test/en/27
http://m.bets365x.test/de/4
https://betting-tips.test/en/90
http://casino-night.test/en/5
https://www.slots-casino.test/fr/18
http://sexy-girls.test/en/33
https://video-sexy.test/es/2
http://spam-posting.test/en/71
https://mail-spam.test/de/19
http://adult-store.test/en/8
https://torrents-hub.test/en/55
"""
ALLOW = """
https://www.citylibrary.test/en/catalogue/4
http://weather.test/forecast/monday
https://blog.gardennotes.test/en/88
http://m.dailynews.test/de/301.html
https://www.oldtown-museum.test/fr/visit
http://recipes.test/soup/12
https://physics.test/lecture/3
http://www.riverside-school.test/en/pupils
https://docs.compiler.test/manual/7
http://history.test/es/1848
https://m.trainlines.test/timetable/9
http://www.hospital.test/en/wards
https://blog.thinker.test/en/145
http://thornton.test/parish/council
https://www.theatre.test/en/tonight
http://nation.test/politics/22
https://station.test/platform/2
http://m.lantern.test/es/70#top
https://blog.auntie.test/fr/16?page=2
http://www.wheelers.test/en/bikes
https://thistle.test/walks/5.html
http://orchard.test/apples
https://www.edition.test/en/chapter/9
http://blog.motion.test/de/33
https://m.fiction.test/en/stories/81
http://together.test/choir
https://www.northern.test/en/lakes/4/
http://weathervane.test/fr/510.html
https://blog.leather.test/es/201
http://m.heather.test/en/77?utm_source=feed
https://www.tithes.test/en/617/
http://shire.test/de/92
https://blog.other.test/en/450?page=2
http://www.hither.test/en/999.html
https://m.breather.test/fr/123#top
http://rational.test/logic/1
https://www.notion.test/en/5
http://blog.tables.test/es/64
https://stable.test/horses/8
http://m.ledger.test/en/accounts
https://www.seminar.test/en/52
http://island.test/ferry
https://blog.handmade.test/wool/30
http://www.mountain.test/de/huts
https://m.harbour.test/en/tides
http://courts.test/rulings/2019
https://www.atlas.test/en/maps/6
http://blog.kitchen.test/fr/bread
https://m.forestry.test/es/14.html
http://village.test/fete
https://www.engineers.test/en/bridges
http://blog.painters.test/en/38
https://statistics.test/tables/17
http://m.farmers-market.test/en/saturday
https://www.freedom-hall.test/concerts
http://sparrow.test/birds/3
https://blog.adults-learn-piano.test/en/4
http://alphabet.test/letters
https://www.pillars.test/greek/2
http://m.loan-desk-library.test/en/books
https://kitten.test/en/14
http://www.chicken-coop.test/fr/61
https://m.hitchhiker.test/es/20
http://blog.kitchenware-museum.test/en/3
https://theatre-school.test/de/73
http://www.guardian-angels.test/en/42
https://gardens.test/en/roses
http://m.evening.test/fr/11
https://blog.semantics.test/en/66
http://www.minaret.test/es/5
https://montane.test/en/29
http://blog.fountains.test/de/16.html
https://www.villa-romana.test/en/47
http://stationer.test/en/paper
https://m.chapter.test/fr/86
http://www.bookbinder.test/en/58
https://blog.winter.test/es/39
http://singers.test/en/24
https://www.listener.test/de/95
http://m.chestnut.test/en/37
https://thunder.test/fr/52
http://blog.ringing.test/en/84
https://www.standing-stones.test/en/6
http://hanging-gardens.test/es/13
https://m.wording.test/en/99
http://www.reader.test/en/150
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``host, path, block`` of the table, 140 rows."""
    host, path = url_parts(F.col("url"))

    def side(listed: str, block: bool) -> DataFrame:
        urls = F.split(F.lit(" ".join(listed.split())), " ")
        return spark.range(1).select(F.explode(urls).alias("url")).select(host.alias("host"), path.alias("path"), F.lit(block).alias("block"))

    return side(BLOCK, True).unionByName(side(ALLOW, False))
