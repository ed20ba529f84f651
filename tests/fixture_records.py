"""Records of the 34 fixture profiles (see FIXTURES.md): number, ein, tin, year, kind,
entity, percent, then amounts in the order of the table there."""

PROFILES = [
    (1, '46-3819204', '621-47-8830', '2024', 'LP', 'Individual', 2.5, None, -42315.0, None, 1840.0, None, None, None, None, 6200.0, None, None, 18000.0, None, 318500.0, 258185.0),
    (2, '81-2047563', '549-82-1173', '2024', 'GP', 'Individual', 20.0, 127615.0, None, 360000.0, 14220.0, 8440.0, 6780.0, 23190.0, 740885.0, None, 487615.0, None, 450000.0, 127615.0, 1284700.0, 1727040.0),
    (3, '27-6534891', '071-56-4422', '2024', 'LP', 'Individual', 0.75, -31740.0, None, None, 18905.0, 4115.0, 1870.0, -87330.0, 12440.0, None, None, 1628.0, None, None, 148200.0, 216460.0),
    (4, '83-1726450', '138-60-7714', '2024', 'LP', 'Individual', 5.25, 87640.0, None, None, 32180.0, 21350.0, 21350.0, -14220.0, 2100000.0, None, None, None, 1500000.0, None, 3841200.0, 4528840.0),
    (5, '75-2893041', '457-31-9962', '2024', 'GP', 'Individual', 15.0, 194780.0, None, 180000.0, 5620.0, None, None, None, 38400.0, 22500.0, 374780.0, 3215.0, 120000.0, 194780.0, 892300.0, 1087080.0),
    (6, '93-2847561', '93-7142608', '2024', 'LP', 'Trust', 22.5, -19315.0, None, None, 1240.0, 3180.0, 2750.0, -4620.0, 6890.0, None, None, None, None, None, 87400.0, 68085.0),
    (7, '86-3091745', '612-74-3891', '2024', 'GP', 'Individual', 16.67, 148440.0, None, 120000.0, 2810.0, None, None, None, None, 8340.0, 268440.0, None, 175000.0, 148440.0, 312750.0, 361190.0),
    (8, '38-4702193', '384-51-7029', '2024', 'LP', 'Individual', 4.8, None, -62180.0, None, 3920.0, None, None, None, 11450.0, 89600.0, None, None, 48000.0, -62180.0, 1840000.0, 1969820.0),
    (9, '54-8031297', '54-1967834', '2024', 'LP', 'Corporation', 12.5, -387620.0, None, None, 8740.0, None, None, None, None, None, None, 47380.0, None, -387620.0, 2150000.0, 2262380.0),
    (10, '58-2614039', '58-3801562', '2024', 'GP', 'S Corporation', 35.0, 28945.0, None, None, None, None, None, None, None, None, None, None, 18000.0, 28945.0, 15000.0, 25945.0),
    (11, '46-3819204', '453-18-7692', '2024', 'LP', 'Individual', 5.0, None, -84630.0, None, 3680.0, None, None, None, None, 12400.0, None, None, 36000.0, None, 637000.0, 516370.0),
    (12, '46-3819204', '46-9127538', '2024', 'GP', 'LLC', 1.0, None, -16926.0, 75000.0, 736.0, None, None, None, None, 2480.0, 58074.0, None, 7200.0, None, 127400.0, 103274.0),
    (13, '86-3091745', '528-63-4107', '2024', 'GP', 'Individual', 16.67, 148440.0, None, 120000.0, 2810.0, None, None, None, None, 8340.0, 268440.0, None, 180000.0, 148440.0, 305200.0, 348640.0),
    (14, '86-3091745', '604-21-8935', '2024', 'GP', 'Individual', 85.0, 756600.0, None, 350000.0, 14340.0, None, None, None, None, 42500.0, 1106600.0, None, 950000.0, 756600.0, 1558000.0, 1619600.0),
    (15, '46-3819204', '621-47-8830', '2023', 'LP', 'Individual', 2.5, None, -12300.0, None, 1420.0, None, None, None, None, 4800.0, None, None, 15000.0, None, 345800.0, 318500.0),
    (16, '81-2047563', '549-82-1173', '2023', 'GP', 'Individual', 20.0, 82400.0, None, 340000.0, 11800.0, 6200.0, 4900.0, 15600.0, 412000.0, None, 422400.0, None, 300000.0, 82400.0, 980400.0, 1100000.0),
    (17, '27-6534891', '071-56-4422', '2023', 'GP', 'Individual', 0.75, -14300.0, None, None, 12400.0, 2800.0, 1200.0, -52100.0, 8200.0, None, -14300.0, 1240.0, None, None, 162500.0, 148200.0),
    (18, '46-3819204', '453-18-7692', '2023', 'LP', 'Individual', 5.0, None, -24600.0, None, 2840.0, None, None, None, None, 9600.0, None, None, 30800.0, None, 692400.0, 637000.0),
    (19, '81-2047563', '572-34-8816', '2024', 'LP', 'Individual', 8.0, 51046.0, None, None, 5688.0, 3376.0, 2712.0, 9276.0, 296354.0, None, None, None, 180000.0, 51046.0, 514000.0, 690940.0),
    (20, '81-2047563', '94-3182750', '2024', 'LP', 'Corporation', 5.0, 31904.0, None, None, 3555.0, 2110.0, 1695.0, 5798.0, 185221.0, None, None, None, 100000.0, None, 321250.0, 444338.0),
    (21, '27-6534891', '27-8941352', '2024', 'GP', 'LLC', 15.0, -634800.0, None, 900000.0, 378100.0, 82300.0, 37400.0, -1746600.0, 248800.0, None, 265200.0, 32560.0, 480000.0, None, 2964000.0, 1849200.0),
    (22, '27-6534891', '042-78-3391', '2024', 'LP', 'Individual', 2.0, -84640.0, None, None, 50413.0, 10973.0, 4987.0, -232880.0, 33173.0, None, None, 4341.0, None, None, 395200.0, 510560.0),
    (23, '83-1726450', '132-45-7803', '2024', 'LP', 'Individual', 3.75, 62600.0, None, None, 22986.0, 15250.0, 15250.0, -10157.0, 1500000.0, None, None, None, 1071429.0, None, 2743714.0, 3234886.0),
    (24, '83-1726450', '83-2918470', '2024', 'GP', 'LLC', 1.0, 16693.0, None, 240000.0, 6130.0, 4067.0, 4067.0, -2709.0, 400000.0, None, 256693.0, None, 285714.0, None, 731657.0, 862636.0),
    (25, '75-2893041', '455-62-8104', '2024', 'LP', 'Individual', 10.0, 129853.0, None, None, 3747.0, None, None, None, 25600.0, 15000.0, None, 2143.0, 80000.0, 129853.0, 594867.0, 724720.0),
    (26, '75-2893041', '451-90-3372', '2024', 'LP', 'Individual', 8.0, 12740.0, None, None, 2998.0, None, None, None, None, 12000.0, None, 1714.0, 180000.0, 12740.0, 475893.0, 308633.0),
    (27, '93-2847561', '543-81-2947', '2024', 'LP', 'Individual', 22.5, -19315.0, None, None, 1240.0, 3180.0, 2750.0, -4620.0, 6890.0, None, None, None, None, None, 87400.0, 68085.0),
    (28, '93-2847561', '543-19-6738', '2024', 'GP', 'Individual', 10.0, -8584.0, None, 24000.0, 551.0, 1413.0, 1222.0, -2053.0, 3062.0, None, 15416.0, None, 6000.0, None, 38844.0, 34260.0),
    (29, '38-4702193', '381-64-9205', '2024', 'LP', 'Individual', 3.2, None, -41453.0, None, 2613.0, None, None, None, 7633.0, 59733.0, None, None, 32000.0, -41453.0, 1226667.0, 1313213.0),
    (30, '38-4702193', '38-5190264', '2024', 'GP', 'LLC', 1.5, None, -19431.0, 120000.0, 1225.0, None, None, None, 3578.0, 28000.0, 100569.0, None, 15000.0, None, 575000.0, 540569.0),
    (31, '54-8031297', '54-2836194', '2024', 'LP', 'LLC', 8.0, -248077.0, None, None, 5594.0, None, None, None, None, None, None, 30323.0, None, -248077.0, 1376000.0, 1447923.0),
    (32, '54-8031297', '223-41-6758', '2024', 'LP', 'Individual', 6.0, -186058.0, None, None, 4195.0, None, None, None, None, None, -186058.0, 22743.0, None, -186058.0, 1032000.0, 1085942.0),
    (33, '58-2614039', '252-83-4190', '2024', 'LP', 'Individual', 25.0, 20675.0, None, None, None, None, None, None, None, None, None, None, 12857.0, 20675.0, 10714.0, 18532.0),
    (34, '58-2614039', '258-47-6021', '2024', 'LP', 'Individual', 15.0, 12405.0, None, None, None, None, None, None, None, None, None, None, 7714.0, 12405.0, 6429.0, 11119.0),
]
