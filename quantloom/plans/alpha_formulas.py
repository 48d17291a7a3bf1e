"""The 101 published formulaic alphas ("101 Formulaic Alphas", 2016), as text.

Fields: o h l c v vw r cap (open, high, low, close, volume, vwap, returns, market capitalization); advN is the mean
of v over N rows.  Over time: lag diff sum mean std tmin tmax prod corr cov trank argmax argmin decay.  Within a date:
rank, scale, neut by sec, ind or sub.  By row: sdiv spow lt iff max2 min2 ln abs sgn sqrt.
"""

# fixed values: formulas and their constants
FORMULAS = """
001 rank(argmax(spow(iff(r<0,std(r,20),c),2.0),5))-0.5
002 -corr(rank(diff(ln(v),2)),rank(sdiv(c-o,o)),6)
003 -corr(rank(o),rank(v),10)
004 -trank(rank(l),9)
005 rank(o-mean(vw,10))*-abs(rank(c-vw))
006 -corr(o,v,10)
007 iff(adv20<v,-trank(abs(diff(c,7)),60)*sgn(diff(c,7)),-1.0)
008 -rank((sum(o,5)*sum(r,5))-lag(sum(o,5)*sum(r,5),10))
009 iff(tmin(diff(c,1),5)>0,diff(c,1),iff(tmax(diff(c,1),5)<0,diff(c,1),-diff(c,1)))
010 rank(iff(tmin(diff(c,1),4)>0,diff(c,1),iff(tmax(diff(c,1),4)<0,diff(c,1),-diff(c,1))))
011 (rank(tmax(vw-c,3))+rank(tmin(vw-c,3)))*rank(diff(v,3))
012 sgn(diff(v,1))*-diff(c,1)
013 -rank(cov(rank(c),rank(v),5))
014 -rank(diff(r,3))*corr(o,v,10)
015 -sum(rank(corr(rank(h),rank(v),3)),3)
016 -rank(cov(rank(h),rank(v),5))
017 -rank(trank(c,10))*rank(diff(diff(c,1),1))*rank(trank(sdiv(v,adv20),5))
018 -rank((std(abs(c-o),5)+c-o)+corr(c,o,10))
019 (-sgn(c-lag(c,7)+diff(c,7)))*(1+rank(1+sum(r,250)))
020 -rank(o-lag(h,1))*rank(o-lag(c,1))*rank(o-lag(l,1))
021 iff(mean(c,8)+std(c,8)<mean(c,2),-1.0,iff(mean(c,2)<mean(c,8)-std(c,8),1.0,iff(sdiv(v,adv20)>=1,1.0,-1.0)))
022 -diff(corr(h,v,5),5)*rank(std(c,20))
023 iff(mean(h,20)<h,-diff(h,2),0.0)
024 iff(sdiv(diff(mean(c,100),100),lag(c,100))<=0.05,-(c-tmin(c,100)),-diff(c,3))
025 rank(-r*adv20*vw*(h-c))
026 -tmax(corr(trank(v,5),trank(h,5),5),3)
027 iff(rank(mean(corr(rank(v),rank(vw),6),2))>0.5,-1.0,1.0)
028 scale(corr(adv20,l,5)+(h+l)/2-c)
029 tmin(prod(rank(rank(scale(ln(sum(tmin(rank(rank(-rank(diff(c-1,5)))),2),1))))),1),5)+trank(lag(-r,6),5)
030 sdiv((1-rank(sgn(diff(c,1))+sgn(lag(diff(c,1),1))+sgn(lag(diff(c,1),2))))*sum(v,5),sum(v,20))
031 rank(rank(rank(decay(-rank(rank(diff(c,10))),10))))+rank(-diff(c,3))+sgn(scale(corr(adv20,l,12)))
032 scale(mean(c,7)-c)+20*scale(corr(vw,lag(c,5),230))
033 rank(o/c-1)
034 rank(2-rank(sdiv(std(r,2),std(r,5)))-rank(diff(c,1)))
035 trank(v,32)*(1-trank(c+h-l,16))*(1-trank(r,32))
036 2.21*rank(corr(c-o,lag(v,1),15))+0.7*rank(o-c)+0.73*rank(trank(lag(-r,6),5))+rank(abs(corr(vw,adv20,6)))+0.6*rank((mean(c,200)-o)*(c-o))
037 rank(corr(lag(o-c,1),c,200))+rank(o-c)
038 -rank(trank(c,10))*rank(sdiv(c,o))
039 -rank(diff(c,7)*(1-rank(decay(sdiv(v,adv20),9))))*(1+rank(sum(r,250)))
040 -rank(std(h,10))*corr(h,v,10)
041 sqrt(h*l)-vw
042 sdiv(rank(vw-c),rank(vw+c))
043 trank(sdiv(v,adv20),20)*trank(-diff(c,7),8)
044 -corr(h,rank(v),5)
045 -rank(mean(lag(c,5),20))*corr(c,v,2)*rank(corr(sum(c,5),sum(c,20),2))
046 iff((lag(c,20)-lag(c,10))/10-(lag(c,10)-c)/10>0.25,-1.0,iff((lag(c,20)-lag(c,10))/10-(lag(c,10)-c)/10<0,1.0,-diff(c,1)))
047 sdiv(rank(1/c)*v,adv20)*sdiv(h*rank(h-c),mean(h,5))-rank(vw-lag(vw,5))
048 sdiv(neut(corr(diff(c,1),diff(lag(c,1),1),250)*diff(c,1)/c,sub),sum(spow(sdiv(diff(c,1),lag(c,1)),2),250))
049 iff((lag(c,20)-lag(c,10))/10-(lag(c,10)-c)/10<-0.1,1.0,-diff(c,1))
050 -tmax(rank(corr(rank(v),rank(vw),5)),5)
051 iff((lag(c,20)-lag(c,10))/10-(lag(c,10)-c)/10<-0.05,1.0,-diff(c,1))
052 -diff(tmin(l,5),5)*rank((sum(r,240)-sum(r,20))/220)*trank(v,5)
053 -diff(sdiv(c-l-(h-c),c-l),9)
054 sdiv(-(l-c)*o**5,(l-h)*c**5)
055 -corr(rank(sdiv(c-tmin(l,12),tmax(h,12)-tmin(l,12))),rank(v),6)
056 -rank(sdiv(sum(r,10),sum(sum(r,2),3)))*rank(r*cap)
057 -sdiv(c-vw,decay(rank(argmax(c,30)),2))
058 -trank(decay(corr(neut(vw,sec),v,3),7),5)
059 -trank(decay(corr(neut(vw*0.728317+vw*(1-0.728317),ind),v,4),16),8)
060 -(2*scale(rank(sdiv(c-l-(h-c),h-l)*v))-scale(rank(argmax(c,10))))
061 lt(rank(vw-tmin(vw,16)),rank(corr(vw,adv180,17)))
062 -lt(rank(corr(vw,sum(adv20,22),9)),rank(lt(rank(o)+rank(o),rank((h+l)/2)+rank(h))))
063 -(rank(decay(diff(neut(c,ind),2),8))-rank(decay(corr(vw*0.318108+o*(1-0.318108),sum(adv180,37),13),12)))
064 -lt(rank(corr(sum(o*0.178404+l*(1-0.178404),12),sum(adv120,12),16)),rank(diff((h+l)/2*0.178404+vw*(1-0.178404),3)))
065 -lt(rank(corr(o*0.00817205+vw*(1-0.00817205),sum(adv60,8),6)),rank(o-tmin(o,13)))
066 -(rank(decay(diff(vw,3),7))+trank(decay(sdiv(l*0.96633+l*(1-0.96633)-vw,o-(h+l)/2),11),6))
067 -spow(rank(h-tmin(h,2)),rank(corr(neut(vw,sec),neut(adv20,sub),6)))
068 -lt(trank(corr(rank(h),rank(adv15),8),13),rank(diff(c*0.518371+l*(1-0.518371),1)))
069 -spow(rank(tmax(diff(neut(vw,ind),2),4)),trank(corr(c*0.490655+vw*(1-0.490655),adv20,4),9))
070 -spow(rank(diff(vw,1)),trank(corr(neut(c,ind),adv50,17),17))
071 max2(trank(decay(corr(trank(c,3),trank(adv180,12),18),4),15),trank(decay(spow(rank(l+o-2*vw),2),16),4))
072 sdiv(rank(decay(corr((h+l)/2,adv40,8),10)),rank(decay(corr(trank(vw,3),trank(v,18),6),2)))
073 -max2(rank(decay(diff(vw,4),2)),trank(decay(-sdiv(diff(o*0.147155+l*(1-0.147155),2),o*0.147155+l*(1-0.147155)),3),16))
074 -lt(rank(corr(c,sum(adv30,37),15)),rank(corr(rank(h*0.0261661+vw*(1-0.0261661)),rank(v),11)))
075 lt(rank(corr(vw,v,4)),rank(corr(rank(l),rank(adv50),12)))
076 -max2(rank(decay(diff(vw,1),11)),trank(decay(trank(corr(neut(l,sec),adv81,8),19),17),19))
077 min2(rank(decay((h+l)/2-vw,20)),rank(decay(corr((h+l)/2,adv40,3),5)))
078 spow(rank(corr(sum(l*0.352233+vw*(1-0.352233),19),sum(adv40,19),6)),rank(corr(rank(vw),rank(v),5)))
079 lt(rank(diff(neut(c*0.60733+o*(1-0.60733),sec),1)),rank(corr(trank(vw,3),trank(adv150,9),14)))
080 -spow(rank(sgn(diff(neut(o*0.868128+h*(1-0.868128),ind),4))),trank(corr(h,adv10,5),5))
081 -lt(rank(ln(prod(rank(spow(rank(corr(vw,sum(adv10,49),8)),4)),14))),rank(corr(rank(vw),rank(v),5)))
082 -min2(rank(decay(diff(o,1),14)),trank(decay(corr(neut(v,sec),o*0.634196+o*(1-0.634196),17),6),13))
083 sdiv(rank(lag(sdiv(h-l,mean(c,5)),2))*rank(rank(v)),sdiv(sdiv(h-l,mean(c,5)),vw-c))
084 spow(trank(vw-tmax(vw,15),20),diff(c,4))
085 spow(rank(corr(h*0.876703+c*(1-0.876703),adv30,9)),rank(corr(trank((h+l)/2,3),trank(v,10),7)))
086 -lt(trank(corr(c,sum(adv20,14),6),20),rank(o+c-vw-o))
087 -max2(rank(decay(diff(c*0.369701+vw*(1-0.369701),1),2)),trank(decay(abs(corr(neut(adv81,ind),c,13)),4),14))
088 min2(rank(decay(rank(o)+rank(l)-rank(h)-rank(c),8)),trank(decay(corr(trank(c,8),trank(adv60,20),8),6),2))
089 trank(decay(corr(l,adv10,6),5),3)-trank(decay(diff(neut(vw,ind),3),10),15)
090 -spow(rank(c-tmax(c,4)),trank(corr(neut(adv40,sub),l,5),3))
091 -(trank(decay(decay(corr(neut(c,ind),v,9),16),3),4)-rank(decay(corr(vw,adv30,4),2)))
092 min2(trank(decay(lt((h+l)/2+c,l+o),14),18),trank(decay(corr(rank(l),rank(adv30),7),6),6))
093 sdiv(trank(decay(corr(neut(vw,ind),adv81,17),19),7),rank(decay(diff(c*0.524434+vw*(1-0.524434),2),16)))
094 -spow(rank(vw-tmin(vw,11)),trank(corr(trank(vw,19),trank(adv60,4),18),2))
095 lt(rank(o-tmin(o,12)),trank(spow(rank(corr(sum((h+l)/2,19),sum(adv40,19),12)),5),11))
096 -max2(trank(decay(corr(rank(vw),rank(v),3),4),8),trank(decay(argmax(corr(trank(c,7),trank(adv60,4),3),12),14),13))
097 -(rank(decay(diff(neut(l*0.721001+vw*(1-0.721001),ind),3),20))-trank(decay(trank(corr(trank(l,7),trank(adv60,17),4),18),15),6))
098 rank(decay(corr(vw,sum(adv5,26),4),7))-rank(decay(trank(argmin(corr(rank(o),rank(adv15),20),8),6),8))
099 -lt(rank(corr(sum((h+l)/2,19),sum(adv60,19),8)),rank(corr(l,v,6)))
100 -((1.5*scale(neut(neut(rank(sdiv(c-l-(h-c),h-l)*v),sub),sub)))-scale(neut(corr(c,rank(adv20),5)-rank(argmin(c,30)),sub)))*sdiv(v,adv20)
101 sdiv(c-o,h-l+0.001)
"""


def formula(number: int) -> str:
    for line in FORMULAS.strip().splitlines():
        if int(line[:3]) == number:
            return line[4:]
    raise ValueError(f"there is no alpha {number}")


def numbers() -> list[int]:
    return [int(line[:3]) for line in FORMULAS.strip().splitlines()]
